"""From samples to districts, plans and distributions, and back from ids to members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import members_of, str_to_vec, vec_to_str, weight_of
from ..functions.keys import numbered


def expand_samples(samples: DataFrame, num_districts: int) -> DataFrame:
    """A row for each sample and district, empty districts included.

    Precincts without a district (negative entries) belong to none.
    """
    each = samples.withColumn("district_id", F.explode(F.sequence(F.lit(0), F.lit(num_districts - 1))))
    each = each.withColumn("members", members_of(F.col("plan_vector"), F.col("district_id")))
    return each.select("step", "sample_tag", "plan_id", "district_id", "members", vec_to_str(F.col("members")).alias("district_str"))


def district_catalog(expanded: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """district_uid, district_str, members (and weight): distinct districts in order of appearance."""
    first = expanded.groupBy("district_str").agg(F.min(F.struct("plan_id", "district_id")).alias("__first"))
    order = [F.col("__first.plan_id"), F.col("__first.district_id")]
    out = numbered(first, order, "district_uid").drop("__first")
    out = out.select("district_uid", "district_str", str_to_vec(F.col("district_str")).alias("members"))
    if weights is not None:
        out = out.crossJoin(F.broadcast(weights.select("weights"))).withColumn("weight", weight_of(F.col("members"), F.col("weights"))).drop("weights")
    return out


def attach_district_ids(expanded: DataFrame, districts: DataFrame) -> DataFrame:
    """The expanded samples with district_uid (null for an unknown district)."""
    return expanded.join(districts.select("district_str", "district_uid"), "district_str", "left")


def summarize_plans(attached: DataFrame) -> DataFrame:
    """step, plan_id, sample_tag, plan (uids by district id), plan_str (uids sorted)."""
    uids = F.transform(F.array_sort(F.collect_list(F.struct("district_id", "district_uid"))), lambda x: x["district_uid"])
    plans = attached.groupBy("step", "plan_id", "sample_tag").agg(uids.alias("plan"))
    return plans.withColumn("plan_str", vec_to_str(F.col("plan")))


def distributions(plans: DataFrame) -> DataFrame:
    """plan_uid, sample_tag, plan_str, count, freq (within its tag), plan_vector (sorted uids)."""
    counts = plans.groupBy("sample_tag", "plan_str").agg(F.count("*").alias("count"))
    tags = counts.groupBy(F.col("sample_tag").alias("__tag")).agg(F.sum("count").alias("__total"))
    out = counts.join(tags, F.col("sample_tag") == F.col("__tag")).withColumn("freq", F.col("count") / F.col("__total")).drop("__tag", "__total")
    out = numbered(out, [F.col("sample_tag"), F.col("plan_str")], "plan_uid")
    vector = F.transform(F.filter(F.split("plan_str", "[.]"), lambda x: x != ""), lambda x: x.cast("bigint"))
    return out.select("plan_uid", "sample_tag", "plan_str", "count", "freq", vector.alias("plan_vector"))


def num_districts_of(plans: DataFrame) -> int:
    """Districts of the first stored plan (in order of plan_id)."""
    row = plans.orderBy("plan_id").select(F.size("plan").alias("n")).first()
    if row is None:
        raise ValueError("there is no plan")
    return int(row["n"])


def encode_district(districts: DataFrame, vector: list[int]) -> int:
    """The uid of a district by its members; an error if it is not in the catalog."""
    text = ".".join(str(v) for v in sorted(vector))
    row = districts.where(F.col("district_str") == text).orderBy("district_uid").first()
    if row is None:
        raise KeyError(f"no district {text!r}")
    return int(row["district_uid"])


def decode_districts(districts: DataFrame) -> DataFrame:
    """district_uid, precinct: the members as rows."""
    return districts.select("district_uid", F.explode("members").alias("precinct"))


def decode_plans(plans: DataFrame, districts: DataFrame, num_precincts: int, key: str = "plan_uid", vector: str = "plan_vector") -> DataFrame:
    """key, precinct, district_id: the label of every precinct.

    Where districts overlap the later one counts; a precinct that none covers has 0.
    """
    each = plans.select(key, F.posexplode(vector).alias("district_id", "district_uid"))
    owned = each.join(decode_districts(districts), "district_uid").groupBy(key, "precinct").agg(F.max("district_id").alias("district_id"))
    grid = plans.select(key).withColumn("precinct", F.explode(F.sequence(F.lit(0), F.lit(num_precincts - 1))))
    return grid.join(owned, [key, "precinct"], "left").select(key, "precinct", F.coalesce("district_id", F.lit(0)).alias("district_id"))
