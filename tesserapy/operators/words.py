"""Words: each plan spelt by the letters nearest to its districts."""

from __future__ import annotations

import heapq
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import vec_to_str, weight_of
from ..functions.keys import numbered
from .cluster import centroid_distances

LETTERS = "array<struct<d:double,pos:int,l:int>>"
WORDS = "array<struct<d:double,w:array<int>>>"


def letter_subset(spark, k: int, subset: list[int] | None = None) -> DataFrame:
    """l, pos: letters in the given order without repeats, or all of them."""
    chosen = list(range(k)) if subset is None else list(dict.fromkeys(int(x) for x in subset))
    return spark.createDataFrame([(x, p) for p, x in enumerate(chosen)], "l int, pos int")


def _lists(distances: DataFrame, letters: DataFrame) -> DataFrame:
    """district_uid, letters: sorted by distance, then by place among the letters."""
    rows = distances.join(F.broadcast(letters), F.col("cluster_id") == F.col("l"))
    entry = F.struct(F.col("d").cast("double").alias("d"), "pos", "l")
    return rows.groupBy("district_uid").agg(F.array_sort(F.collect_list(entry)).alias("letters"))


def letters_by_centroid(districts: DataFrame, centroid_rows: DataFrame, weights: DataFrame, letters: DataFrame) -> DataFrame:
    """Letter lists by capped set distance to the centroids."""
    return _lists(centroid_distances(districts, centroid_rows, weights), letters)


def density_distances(districts: DataFrame, density: DataFrame, weights: DataFrame) -> DataFrame:
    """district_uid, cluster_id, d: capped weighted L1 distance to the densities."""
    per = F.transform(F.array_sort(F.collect_list(F.struct("precinct", "dens"))), lambda x: x["dens"])
    one = weights.select("weights", "cap")
    rows = density.groupBy("cluster_id").agg(per.alias("dens")).crossJoin(F.broadcast(one.select("weights")))
    mass = F.aggregate(F.zip_with("dens", "weights", lambda d, w: d * w), F.lit(0.0), lambda s, x: s + x)
    rows = rows.select("cluster_id", "dens", mass.alias("mass"))
    each = districts.select("district_uid", "members").crossJoin(F.broadcast(one)).withColumn("w", weight_of(F.col("members"), F.col("weights")))
    each = each.crossJoin(F.broadcast(rows))
    shared = F.aggregate("members", F.lit(0.0), lambda s, p: s + F.get("dens", p) * F.get("weights", p))
    d = F.least(F.greatest(F.col("mass") + F.col("w") - 2.0 * shared, F.lit(0.0)), F.col("cap").cast("double"))
    return each.select("district_uid", "cluster_id", d.alias("d"))


def letters_by_density(districts: DataFrame, density: DataFrame, weights: DataFrame, letters: DataFrame) -> DataFrame:
    """Letter lists by capped weighted L1 distance to the densities (the mode named "l2")."""
    return _lists(density_distances(districts, density, weights), letters)


def beam(lists: Column, degree: int, cap: float | None = None) -> Column:
    """The ``degree`` nearest words over letter lists, by (distance, word).

    Partial words meet letters at ranks a, b with a + b < degree only: any other
    pair is dominated by as many words as are kept. A word over the cap is dropped.
    """
    within = (lambda arr: arr) if cap is None else (lambda arr: F.filter(arr, lambda c: c["d"] <= F.lit(float(cap))))

    def extend(words: Column, letters: Column) -> Column:
        grown = F.transform(
            words,
            lambda c, a: F.transform(
                F.slice(letters, F.lit(1), F.greatest(F.lit(degree) - a, F.lit(0))),
                lambda x: F.struct((c["d"] + x["d"]).alias("d"), F.concat(c["w"], F.array(x["l"])).alias("w")),
            ),
        )
        return F.slice(F.array_sort(within(F.flatten(grown))), 1, degree).cast(WORDS)

    start = F.array(F.struct(F.lit(0.0).alias("d"), F.array().cast("array<int>").alias("w"))).cast(WORDS)
    return F.aggregate(lists, start, extend)


def heap_words(lists: list, degree: int, cap: float | None = None) -> list[tuple[float, list[int]]]:
    """The ``degree`` nearest words of one plan, ties as a bounded heap leaves them.

    A full heap lets go of the farthest word and, of equally far ones, of the
    smallest. What stays is sorted by distance alone, so equal distances follow
    the heap's array, and that order ranks them when the next letters come.
    """
    words: list[tuple[float, list[int]]] = [(0.0, [])]
    for letters in lists:
        grown = ((d + x["d"], [*w, x["l"]]) for rank, (d, w) in enumerate(words) for x in letters[: degree - rank])
        heap: list = []
        for d, w in grown:
            if cap is None or d <= cap:
                (heapq.heappush if len(heap) < degree else heapq.heappushpop)(heap, (-d, w))
        words = sorted(((0.0 - d, w) for d, w in heap), key=itemgetter(0))
    return words


def heap_beam(lists: Column, degree: int, cap: float | None = None) -> Column:
    """heap_words as a column: Arrow batches to Python, as the order is that of a heap's array."""
    return F.udf(lambda x: heap_words(x, degree, cap), WORDS, useArrow=True).asNondeterministic()(lists)


#: How words of equal distance are kept and ordered.
BEAMS = {"word": beam, "heap": heap_beam}


def enumerate_words(dist: DataFrame, letter_lists: DataFrame, degree: int, dedupe: bool = True, cap: float | None = None, dedupe_key: str = "plan_str", ties: str = "word") -> DataFrame:
    """plan_uid, place, word, distance, min_distance, plan_str, word_str, word_uid.

    Words of equal distance are kept and ordered by their letters, or with
    ties="heap" as a bounded heap does.

    With dedupe, words are sorted multisets of letters, and of the rows that
    share plan_str and word_str the first stays (so a plan that occurs under two
    tags keeps its words once; dedupe_key="plan_uid" keeps them for each). A plan
    without a word under the cap has no rows. word_uid numbers the distinct
    word_str in their order.
    """
    each = dist.select("plan_uid", "plan_str", F.posexplode("plan_vector").alias("k", "district_uid")).join(letter_lists, "district_uid")
    lists = F.transform(F.array_sort(F.collect_list(F.struct("k", "letters"))), lambda x: x["letters"])
    plans = each.groupBy("plan_uid", "plan_str").agg(lists.alias("lists"))
    found = plans.withColumn("words", BEAMS[ties](F.col("lists"), degree, cap)).where(F.size("words") > 0)
    rows = found.select("plan_uid", "plan_str", F.col("words")[0]["d"].alias("min_distance"), F.posexplode("words").alias("place", "x"))
    word = F.array_sort("x.w") if dedupe else F.col("x.w")
    rows = rows.select("plan_uid", "place", word.alias("word"), F.col("x.d").alias("distance"), "min_distance", "plan_str")
    rows = rows.withColumn("word_str", vec_to_str(F.col("word")))
    if dedupe:
        first = Window.partitionBy(dedupe_key, "word_str").orderBy("plan_uid", "place")
        rows = rows.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    names = numbered(rows.select("word_str").distinct(), [F.col("word_str")], "word_uid")
    return rows.join(names, "word_str").select("plan_uid", "place", "word", "distance", "min_distance", "plan_str", "word_str", "word_uid")
