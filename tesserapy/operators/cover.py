"""Pruning of words: a greedy cover of the plans by few words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import numbered
from ..sources.shared import checkpoint

#: Rounds whose picks are merged into one table before the lineage grows further.
MERGED = 8


def near_words(words: DataFrame, eta: float) -> DataFrame:
    """plan_uid, word_uid: the words that cover a plan, those within eta of it."""
    return words.where(F.col("distance") <= F.lit(float(eta))).select("plan_uid", "word_uid").distinct()


def greedy_cover(covers: DataFrame, plan: str = "plan_uid", word: str = "word_uid") -> tuple[DataFrame, DataFrame]:
    """word, place, gain of the words that a greedy cover picks, and plan, word, place of the plans by the word that covered them first.

    Greedy takes the word that covers most plans not yet covered, the smallest of
    equals. A word whose gain is above that of every word it shares such a plan
    with keeps its gain until it is picked, since only picks of words it shares
    plans with lower it, and they come later. So each round picks all these words
    at once, each as greedy would; sorted by gain and word they are greedy's
    order. A round is two aggregations and a join over the edges that are left:
    gains by word, and the best word of each plan. No row holds a word's plans.
    """
    left = checkpoint(covers.select(F.col(plan).alias("p"), F.col(word).alias("w")).where("p is not null and w is not null").distinct())
    picks = covered = None
    rounds = 0
    while left.take(1):
        gains = left.groupBy("w").agg(F.count("*").alias("gain"))
        rank = F.struct("gain", (-F.col("w")).alias("order"), "w")
        best = checkpoint(left.join(gains, "w").groupBy("p").agg(F.max(rank).alias("best")).select("p", F.col("best.w").alias("w"), F.col("best.gain").alias("gain")))
        won = checkpoint(best.groupBy("w", "gain").agg(F.count("*").alias("plans")).where("plans = gain").select("w", "gain"))
        gone = best.join(won.select("w"), "w").select("p", "w")
        left = checkpoint(left.join(gone.select("p"), "p", "left_anti"))
        picks, covered = (won, gone) if picks is None else (picks.unionByName(won), covered.unionByName(gone))
        rounds += 1
        if rounds % MERGED == 0:
            picks, covered = checkpoint(picks), checkpoint(covered)
    if picks is None:
        picks = left.select("w", F.lit(0).cast("bigint").alias("gain"))
        covered = left.select("p", "w")
    placed = checkpoint(numbered(picks, [F.desc("gain"), F.col("w")], "place"))
    owners = covered.join(placed.select("w", "place"), "w")
    return placed.select(F.col("w").alias(word), "place", "gain"), owners.select(F.col("p").alias(plan), F.col("w").alias(word), "place")
