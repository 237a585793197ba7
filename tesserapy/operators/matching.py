"""Distance of plans: the cheapest matching of their districts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import set_distance, weight_of
from ..functions.keys import numbered

#: Districts of a plan at most: the assignment keeps a number for each subset of them.
MOST = 16


def cheapest_matching(costs: Column, n: int) -> Column:
    """Total of the cheapest one-to-one matching, of an n x n array of arrays of bigint.

    One pass over the rows: the state is an array by subset of the columns, in
    which a subset of k columns holds the least total of the first k rows on just
    these columns. A subset is told by its number's bits; subsets of another size
    than the row's number hold null, which least() skips.
    """
    if not 0 <= n <= MOST:
        raise ValueError(f"a matching of {n} districts; {MOST} at most")
    if n == 0:
        return F.lit(0).cast("bigint")
    subsets = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    start = F.transform(subsets, lambda s: F.when(s == 0, F.lit(0).cast("bigint")))

    def row(state: Column, k: Column) -> Column:
        def least(s: Column) -> Column:
            ways = [F.when(s.bitwiseAND(1 << j) != 0, F.get(state, s - (1 << j)) + F.get(F.get(costs, k), F.lit(j))) for j in range(n)]
            return F.when(F.bit_count(s) == k + 1, F.least(*ways) if n > 1 else ways[0])

        return F.transform(subsets, least)

    found = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, row)
    return F.get(found, F.lit((1 << n) - 1))


def spelt_plans(plans: DataFrame, districts: DataFrame, weights: DataFrame, vector: str = "plan_vector", key: str = "plan_str") -> DataFrame:
    """key, sets: one row for each different plan, with the members and weight of its districts in the vector's order."""
    once = plans.groupBy(key).agg(F.min(vector).alias("v"))
    one = weights.select("weights")
    sets = districts.select("district_uid", "members").crossJoin(F.broadcast(one)).select("district_uid", F.struct("members", weight_of(F.col("members"), F.col("weights")).alias("w")).alias("s"))
    each = once.select(key, F.posexplode("v").alias("k", "district_uid")).join(sets, "district_uid")
    order = F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"])
    return each.groupBy(key).agg(order.alias("sets"))


def plan_distances(pairs: DataFrame, spelt: DataFrame, weights: DataFrame, n: int, key: str = "plan_str") -> DataFrame:
    """The rows of one, other (keys of plans) with d, the cheapest matching of their districts under the capped set distance.

    Each different pair is computed once, whatever the number of rows that ask
    for it; two equal plans are 0 apart. A plan of fewer than n districts leaves
    districts of the other unmatched, at the cap each; one of more is an error.
    """
    asked = pairs.select("one", "other").distinct().select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")).distinct()
    left, right = spelt.select(F.col(key).alias("a"), F.col("sets").alias("x")), spelt.select(F.col(key).alias("b"), F.col("sets").alias("y"))
    met = asked.join(left, "a").join(right, "b").crossJoin(F.broadcast(weights.select("weights", "cap")))
    cap = F.col("cap").cast("bigint")

    def cost(k: Column, j: Column) -> Column:
        a, b = F.get("x", k), F.get("y", j)
        d = set_distance(a["members"], b["members"], a["w"], b["w"], F.col("weights"), cap)
        return F.when(a.isNull() & b.isNull(), F.lit(0).cast("bigint")).when(a.isNull() | b.isNull(), cap).otherwise(d)

    places = F.sequence(F.lit(0), F.lit(n - 1))
    matrix = F.transform(places, lambda k: F.transform(places, lambda j: cost(k, j)))
    long = F.greatest(F.size("x"), F.size("y")) > n
    checked = F.when(long, F.raise_error(F.lit(f"a plan has over {n} districts")).cast("array<array<bigint>>")).otherwise(matrix)
    # The matrix is a column of its own, so that the assignment reads it and does not compute it again for each subset.
    rows = met.select("a", "b", checked.alias("costs"))
    found = rows.select("a", "b", cheapest_matching(F.col("costs"), n).alias("d"))
    out = pairs.withColumn("a", F.least("one", "other")).withColumn("b", F.greatest("one", "other"))
    return out.join(found, ["a", "b"]).drop("a", "b")


def next_plans(plans: DataFrame, tag: str = "sample_tag", step: str = "step", key: str = "plan_str") -> DataFrame:
    """tag, step, next_step, one, other: each plan of a chain and the next one's key, in order of step.

    Plans are numbered over all chains without a window by chain, so a chain may
    hold all of them; the next plan is found by an equi-join of numbers.
    """
    rows = numbered(plans.select(tag, step, F.col(key).alias("one")), [F.col(tag), F.col(step)], "__n")
    after = rows.select((F.col("__n") - 1).alias("__n"), F.col(tag).alias("__tag"), F.col(step).alias("next_step"), F.col("one").alias("other"))
    return rows.join(after, "__n").where(F.col(tag).eqNullSafe(F.col("__tag"))).select(tag, step, "next_step", "one", "other")
