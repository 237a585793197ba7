"""Pairwise district distances, pairs within a bound, and quantile edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import dense_l1, indicator, set_distance, weight_of
from ..sources.shared import checkpoint

#: Districts of a block, about: the parts of a join hold the pairs of two blocks.
BLOCK = 256


def pair_distances(districts: DataFrame, weights: DataFrame) -> DataFrame:
    """i, j, d for i > j: capped weight of the symmetric difference.

    All pairs are the result itself (n (n - 1) / 2 rows). Districts are dealt into
    blocks of about BLOCK, and each pair of blocks meets in an equi-join, so a
    district is sent once for each block, none is broadcast, and a part of the
    join is as large whatever the number of districts. Set weights are computed
    once for each district, before the join.
    """
    one = weights.select("weights", "cap")
    rows = districts.select("district_uid", "members").crossJoin(F.broadcast(one)).withColumn("w", weight_of(F.col("members"), F.col("weights")))
    rows = rows.select("district_uid", "members", "w")
    d = set_distance(F.col("a"), F.col("b"), F.col("wa"), F.col("wb"), F.col("weights"), F.col("cap"))
    met = _met(rows.toDF("i", "a", "wa"), rows.toDF("j", "b", "wb"), districts.count())
    return met.crossJoin(F.broadcast(one)).select("i", "j", d.alias("d"))


def _met(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """Pairs of rows with i > j of n rows on each side, by pairs of blocks."""
    blocks = max(1, -(-n // BLOCK))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = left.withColumn("p", F.pmod("i", F.lit(blocks)).cast("int")).withColumn("q", each)
    right = right.withColumn("q", F.pmod("j", F.lit(blocks)).cast("int")).withColumn("p", each)
    return left.join(right, ["p", "q"]).where("i > j").drop("p", "q")


def dense_pair_distances(districts: DataFrame, weights: DataFrame, capped: bool = True) -> DataFrame:
    """i, j, d for i > j over 0/1 vectors, as doubles."""
    one = weights.select("weights", "cap")
    rows = districts.select("district_uid", "members").crossJoin(F.broadcast(one))
    rows = rows.select("district_uid", indicator(F.col("members"), F.size("weights")).alias("v"))
    d = dense_l1(F.col("a"), F.col("b"), F.col("weights"), F.col("cap") if capped else None)
    return _met(rows.toDF("i", "a"), rows.toDF("j", "b"), districts.count()).crossJoin(F.broadcast(one)).select("i", "j", d.alias("d"))


def sampled(districts: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n districts in the order of a seeded hash (all, if there are fewer)."""
    return districts.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("district_str")).cast("binary")), "district_str").limit(n)


#: Bins that a range is split into when ranks are looked for.
BINS = 1024


def ordered_values(values: DataFrame, ranks: list[int], bins: int = BINS) -> dict[int, int]:
    """The values (a column v of integers) at these ranks, counted from 0 in ascending order.

    Ranges that hold a rank are split into bins, whose counts tell in which bin
    the rank lies, until a bin is one value. A round counts in one aggregation
    over the values; its rows are the bins of the ranges still open, at most bins
    for each rank, whatever the number of values. No task holds the values.
    """
    ends = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n")).first()
    wanted = sorted(set(ranks))
    if wanted and (wanted[0] < 0 or wanted[-1] >= ends["n"]):
        raise ValueError("a rank beyond the values")
    found: dict[int, int] = {}
    # Open ranges: first value, last value, and the ranks in it, counted from the range's own start.
    open_ranges = [(ends["low"], ends["high"], [(r, r) for r in wanted])] if wanted else []
    while open_ranges:
        for low, _, inside in (x for x in open_ranges if x[0] == x[1]):
            found |= {rank: low for rank, _ in inside}
        open_ranges = [x for x in open_ranges if x[0] < x[1]]
        if not open_ranges:
            break
        rows = [(k, low, high, max(1, -(-(high - low + 1) // bins))) for k, (low, high, _) in enumerate(open_ranges)]
        table = values.sparkSession.createDataFrame(rows, "range int, low bigint, high bigint, width bigint")
        each = values.join(F.broadcast(table), (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        counts = each.groupBy("range", F.expr("(v - low) div width").alias("bin")).agg(F.count("*").alias("n")).collect()
        by_range: dict[int, list] = {}
        for r in sorted(counts):
            by_range.setdefault(r["range"], []).append(r)
        following = []
        for k, low, high, width in rows:
            before, inside = 0, iter(open_ranges[k][2])
            rank = next(inside, None)
            for r in by_range[k]:
                here = []
                while rank is not None and rank[1] < before + r["n"]:
                    here.append((rank[0], rank[1] - before))
                    rank = next(inside, None)
                before += r["n"]
                if here:
                    start = low + r["bin"] * width
                    following.append((start, min(start + width - 1, high), here))
        open_ranges = following
    return found


def quantile_edges(distances: DataFrame, cap: int, bins: int) -> DataFrame:
    """One row: edges array<int>, of distances below the cap and the pads -1 and cap + 1.

    Exact linear quantiles, cut to integers, sorted and distinct. Distances are
    written once and their ranks found by refining histograms.
    """
    spark = distances.sparkSession
    pads = spark.createDataFrame([(-1,), (cap + 1,)], "v bigint")
    padded = checkpoint(distances.select(F.col("d").cast("bigint").alias("v")).where(F.col("v") < cap).unionByName(pads))
    last = padded.count() - 1
    points = [k / bins * last for k in range(bins + 1)]
    at = ordered_values(padded, [r for p in points for r in (int(p), min(int(p) + 1, last))])
    edges = set()
    for p in points:
        low, share = int(p), p - int(p)
        one, two = at[low], at[min(low + 1, last)]
        edges.add(int(one if share == 0 else (1 - share) * one + share * two))
    return spark.createDataFrame([(sorted(edges),)], "edges array<int>")


def near_candidates(districts: DataFrame, weights: DataFrame, bound: int) -> DataFrame:
    """i, j of the pairs with i > j whose distance may be within the bound; every pair within it is one of them.

    Members are taken in one order, rarest precinct first. If two sets are within
    the bound, what stands before their first common member weighs at most the
    bound in both together, and their weights differ by at most the bound. So each
    set is indexed only by the members before which it holds no more than the
    bound. Sets without a common member are within it only if both together weigh
    no more; such pairs of light sets all belong to the result.
    """
    rows = districts.select("district_uid", "members").crossJoin(F.broadcast(weights.select("weights")))
    rows = rows.select("district_uid", "members", "weights", weight_of(F.col("members"), F.col("weights")).alias("w"))
    each = rows.select("district_uid", "w", F.explode("members").alias("p"), F.col("weights"))
    each = each.select("district_uid", "w", "p", F.get("weights", F.col("p")).alias("own"))
    often = each.groupBy("p").agg(F.count("*").alias("often"))
    order = Window.partitionBy("district_uid").orderBy("often", "p").rowsBetween(Window.unboundedPreceding, -1)
    index = each.join(often, "p").withColumn("before", F.coalesce(F.sum("own").over(order), F.lit(0)))
    index = index.where(F.col("before") <= bound).select("district_uid", "w", "p", "before")
    one, two = index.toDF("i", "wi", "p", "bi"), index.toDF("j", "wj", "p", "bj")
    close = (F.col("i") > F.col("j")) & (F.abs(F.col("wi") - F.col("wj")) <= bound) & (F.col("bi") + F.col("bj") <= bound)
    met = one.join(two, "p").where(close).select("i", "j")
    light = rows.where(F.col("w") <= bound).select("district_uid", "w")
    apart = _met(light.toDF("i", "wi"), light.toDF("j", "wj"), light.count()).where(F.col("wi") + F.col("wj") <= bound).select("i", "j")
    return met.unionByName(apart).distinct()


def near_pairs(districts: DataFrame, weights: DataFrame, bound: int) -> DataFrame:
    """i, j, d for i > j: the pairs whose distance (not capped) is within the bound, without making all pairs."""
    one = weights.select("weights")
    rows = districts.select("district_uid", "members").crossJoin(F.broadcast(one))
    rows = rows.select("district_uid", "members", weight_of(F.col("members"), F.col("weights")).alias("w"))
    met = near_candidates(districts, weights, bound).join(rows.toDF("i", "a", "wa"), "i").join(rows.toDF("j", "b", "wb"), "j").crossJoin(F.broadcast(one))
    d = set_distance(F.col("a"), F.col("b"), F.col("wa"), F.col("wb"), F.col("weights"))
    return met.select("i", "j", d.alias("d")).where(F.col("d") <= bound)
