"""Stratified draws of plans: a weighted sample of each stratum, with inclusion weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import positive

#: Parts that a stratum's rows are dealt into before its smallest keys are told.
PARTS = 64
#: Hex digits of a hash that make a number between 0 and 1, and the number of their values.
HEX, VALUES = 12, 1 << 48


def unit(seed: int, *parts: Column) -> Column:
    """A number above 0 and below 1 that follows from the parts alone."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX), 16, 10).cast("double") + 0.5) / float(VALUES)


def stratified_draw(weighted: DataFrame, size: int, seed: int = 0, parts: int = PARTS) -> DataFrame:
    """word_uid, plan_uid, w, key, inclusion: up to ``size`` plans of each stratum, drawn without replacement by weight.

    A plan belongs to the strata of its words with weight phi_freq. Its key is
    exponential with that rate, and the smallest keys of a stratum are drawn. Given
    the smallest key left out, a plan was drawn with probability
    1 - exp(-w key), its inclusion; so a sum over the stratum is estimated by the
    drawn plans' terms over their inclusions. Where nothing is left out it is 1.
    Keys follow from the seed and the ids, so reruns agree. Ties go to the smaller
    plan. A stratum may hold most plans: its rows are dealt into parts, each of
    which keeps ``size`` + 1 of them, before one task compares what is kept.
    """
    w = F.col("phi_freq")
    rows = weighted.where(positive(w)).select("word_uid", "plan_uid", w.alias("w"), (-F.log(unit(seed, F.col("word_uid"), F.col("plan_uid"))) / w).alias("key"))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("plan_uid"), F.lit(parts)))
    near = Window.partitionBy("word_uid", "part").orderBy("key", "plan_uid")
    kept = dealt.withColumn("place", F.row_number().over(near)).where(F.col("place") <= size + 1).drop("part", "place")
    order = Window.partitionBy("word_uid").orderBy("key", "plan_uid")
    ranked = kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size + 1)
    out = F.max(F.when(F.col("place") == size + 1, F.col("key"))).over(Window.partitionBy("word_uid"))
    found = ranked.withColumn("out", out).where(F.col("place") <= size)
    inclusion = F.when(F.col("out").isNull(), F.lit(1.0)).otherwise(-F.expm1(-F.col("w") * F.col("out")))
    return found.select("word_uid", "plan_uid", "w", "key", inclusion.alias("inclusion"))


def estimated_weights(drawn: DataFrame) -> DataFrame:
    """word_uid, drawn, estimate: each stratum's weight as its draw tells it."""
    return drawn.groupBy("word_uid").agg(F.count("*").alias("drawn"), F.sum(F.col("w") / F.col("inclusion")).alias("estimate"))
