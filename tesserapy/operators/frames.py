"""Data behind the figures: labels, values and colours by precinct."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def district_mask(spark, num_precincts: int, mask: list) -> DataFrame:
    """precinct, selected: from a list of indices, or from one flag for each precinct.

    Integers are indices unless there are as many as precincts; then, and for
    booleans, they are flags.
    """
    values = list(mask)
    indexed = bool(values) and all(isinstance(v, int) and not isinstance(v, bool) for v in values) and len(values) != num_precincts
    chosen = {int(v) for v in values} if indexed else {k for k, v in enumerate(values) if v}
    rows = spark.range(num_precincts).select(F.col("id").cast("int").alias("precinct"))
    picked = spark.createDataFrame([(c,) for c in sorted(chosen)], "p int")
    return rows.join(picked, F.col("precinct") == F.col("p"), "left").select("precinct", F.col("p").isNotNull().alias("selected"))


def district_masks(districts: DataFrame, num_precincts: int) -> DataFrame:
    """district_uid, precinct, selected: the mask of every district."""
    each = districts.select("district_uid", "members", F.explode(F.sequence(F.lit(0), F.lit(num_precincts - 1))).alias("precinct"))
    return each.select("district_uid", "precinct", F.array_contains("members", F.col("precinct")).alias("selected"))


def with_geometry(rows: DataFrame, shapes: DataFrame, key: str = "precinct") -> DataFrame:
    """The rows with the shape of their precinct."""
    return rows.join(shapes.withColumnRenamed("id", "__id"), F.col(key) == F.col("__id")).drop("__id")


def word_letters(spark, word: list[int]) -> DataFrame:
    """place, letter of a word's letters in order."""
    return spark.createDataFrame([(k, int(x)) for k, x in enumerate(word)], "place int, letter int")


def letter_values(density: DataFrame, word: DataFrame) -> DataFrame:
    """place, letter, precinct, value, with vmin and vmax shared by the facets."""
    rows = word.join(density, F.col("letter") == F.col("cluster_id"))
    bounds = rows.agg(F.min("dens").alias("vmin"), F.max("dens").alias("__vmax"))
    # Equal within the usual tolerance: 1e-8 plus 1e-5 of the larger one.
    close = F.abs(F.col("__vmax") - F.col("vmin")) <= 1e-8 + 1e-5 * F.abs(F.col("__vmax"))
    bounds = bounds.select("vmin", F.when(close, F.col("vmin") + 1e-9).otherwise(F.col("__vmax")).alias("vmax"))
    return rows.crossJoin(F.broadcast(bounds)).select("place", "letter", "precinct", F.col("dens").alias("value"), "vmin", "vmax")


def left_to_right(density: DataFrame, word: DataFrame, centers: DataFrame, threshold: float | None = None) -> DataFrame:
    """place, letter, x, rank: letters by their centre, ties by place.

    The centre is the density-weighted mean of x, or with a threshold the plain
    mean of x over the precincts that reach it; infinite for an empty letter.
    centers: precinct, x.
    """
    rows = word.join(density, F.col("letter") == F.col("cluster_id")).join(centers, "precinct")
    if threshold is None:
        x = F.when(F.sum("dens") > 0, F.sum(F.col("x") * F.col("dens")) / F.nullif(F.sum("dens"), F.lit(0.0)))
    else:
        x = F.avg(F.when(F.col("dens") >= threshold, F.col("x")))
    found = rows.groupBy("place", "letter").agg(F.coalesce(x, F.lit(float("inf"))).alias("x"))
    # A word has as many letters as a plan has districts.
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("x", "place")) - 1)


def letter_alphas(density: DataFrame, word: DataFrame) -> DataFrame:
    """place, letter, precinct, alpha: density over the letter's largest; all-zero letters have no rows."""
    peak = F.max("dens").over(Window.partitionBy("place"))
    rows = word.join(density, F.col("letter") == F.col("cluster_id")).withColumn("peak", peak).where("peak > 0")
    return rows.select("place", "letter", "precinct", F.least(F.greatest(F.col("dens") / F.col("peak"), F.lit(0.0)), F.lit(1.0)).alias("alpha"))


def letter_blend(density: DataFrame, word: DataFrame, colours: DataFrame, threshold: float = 0.5) -> DataFrame:
    """precinct, r, g, b, letters, overlap: colours weighed by densities that reach the threshold.

    colours: place, cr, cg, cb. Precincts that no letter reaches have null colours.
    """
    reach = F.col("dens") >= threshold
    rows = word.join(density, F.col("letter") == F.col("cluster_id")).join(colours, "place").withColumn("m", F.when(reach, F.col("dens")).otherwise(0.0))
    total = F.nullif(F.sum("m"), F.lit(0.0))
    mean = [(F.sum(F.col("m") * F.col(c)) / total).alias(name) for c, name in (("cr", "r"), ("cg", "g"), ("cb", "b"))]
    out = rows.groupBy("precinct").agg(*mean, F.sum(reach.cast("int")).cast("bigint").alias("letters"))
    return out.withColumn("overlap", F.col("letters") > 1)
