"""A plan ensemble derived from orders: one contiguous plan of a 5 x 5 grid for each period.

The 25 nations are the cells of the grid. Every period walks the grid along a
boustrophedon path (along rows or columns) and cuts it into three runs of about
equal order volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE, DISTRICTS = 5, 3


def precincts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """precinct, population (customers of the nation)."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("precinct"))
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("population"))
    return nation.join(people, F.col("precinct") == F.col("k"), "left").select("precinct", F.coalesce("population", F.lit(0)).alias("population"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: weights array<bigint> by precinct, total, cap."""
    pairs = F.array_sort(F.collect_list(F.struct("precinct", "population")))
    one = precincts(spark, sf_dir).agg(F.transform(pairs, lambda x: x["population"]).alias("weights"), F.sum("population").alias("total"))
    return one.withColumn("cap", F.floor(F.col("total") * 2 / DISTRICTS).cast("bigint"))


def assignments(spark: SparkSession, sf_dir: str, unit: str = "week", shared_tags: bool = False) -> DataFrame:
    """step, sample_tag, precinct, district_id.

    shared_tags names the tags so that one plan can occur under both.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.date_trunc(unit, "o_orderdate").alias("t"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("p"))
    volume = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("t", "p").agg(F.count("*").alias("n"))
    # One row for each period of the calendar, so a single window is small.
    steps = volume.select("t").distinct().withColumn("step", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("t")))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("precinct"))
    keys = F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))
    cells = steps.withColumn("precinct", F.explode(keys)).join(nation, "precinct", "left_semi")
    cells = cells.join(volume.select(F.col("t").alias("vt"), "p", "n"), (F.col("t") == F.col("vt")) & (F.col("precinct") == F.col("p")), "left")
    x, y = F.floor(F.col("precinct") / SIDE).cast("bigint"), F.col("precinct") % SIDE
    turn = F.col("step") % 4
    by_row = turn.isin(0, 2)
    along = F.when(by_row, x * SIDE + F.when(x % 2 == 0, y).otherwise(SIDE - 1 - y)).otherwise(y * SIDE + F.when(y % 2 == 0, x).otherwise(SIDE - 1 - x))
    cells = cells.select("step", turn.alias("turn"), "precinct", along.alias("k"), (F.coalesce("n", F.lit(0)) + 1).alias("w"))
    path = Window.partitionBy("step").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("cw", F.sum("w").over(path)).withColumn("tw", F.sum("w").over(Window.partitionBy("step")))
    district = F.least(F.floor((F.col("cw") - F.col("w")) * DISTRICTS / F.col("tw")).cast("int"), F.lit(DISTRICTS - 1))
    tag = F.when(F.col("turn") < 2, "a").otherwise("b") if shared_tags else F.when(F.col("turn").isin(0, 2), "row").otherwise("col")
    return cells.select("step", tag.alias("sample_tag"), "precinct", district.alias("district_id"))


def samples(spark: SparkSession, sf_dir: str, unit: str = "week", shared_tags: bool = False) -> DataFrame:
    """plan_id, step, sample_tag, plan_vector: as an atlas of samples would be read."""
    rows = assignments(spark, sf_dir, unit, shared_tags)
    pairs = F.array_sort(F.collect_list(F.struct("precinct", "district_id")))
    plans = rows.groupBy("step", "sample_tag").agg(F.transform(pairs, lambda x: x["district_id"]).alias("plan_vector"))
    return plans.select((F.col("step") - 1).cast("bigint").alias("plan_id"), F.col("step").cast("bigint").alias("step"), "sample_tag", "plan_vector")
