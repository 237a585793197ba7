"""Partition of unity over words, stationary weights, flux and spectra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import NAN, or_null, positive, ratio


def pou_weights(words: DataFrame, dist: DataFrame, temp: float, strict: bool = False) -> DataFrame:
    """The words with plan_freq, phi, phi_normalized, phi_freq.

    phi = exp(-temp (distance / min_distance - 1)), the ratio being 1 where both
    are zero. At temp 0 a positive distance over a zero minimum gives NaN, as the
    product of zero and infinity does; ``strict`` takes 0 there instead.
    """
    rows = words.join(dist.select("plan_uid", F.col("freq").alias("plan_freq")), "plan_uid", "left")
    both = (F.col("distance") == 0) & (F.col("min_distance") == 0)
    r = F.when(both, F.lit(1.0)).otherwise(ratio(F.col("distance"), F.col("min_distance")))
    r = F.nanvl(r, F.lit(1.0))
    phi = F.exp(F.lit(-float(temp)) * (r - 1.0))
    rows = rows.withColumn("phi", F.nanvl(phi, F.lit(0.0)) if strict else phi)
    total = F.sum(or_null(F.col("phi"))).over(Window.partitionBy("plan_uid"))
    share = F.when(F.isnan("phi"), F.lit(NAN)).otherwise(ratio(F.col("phi"), total))
    return rows.withColumn("phi_normalized", share).withColumn("phi_freq", F.col("phi_normalized") * F.col("plan_freq"))


def stationary(weighted: DataFrame) -> DataFrame:
    """word_uid, word_str, stationary: phi_freq summed by word, NaN skipped."""
    out = weighted.groupBy("word_uid", "word_str").agg(F.sum(or_null(F.col("phi_freq"))).alias("s"))
    return out.select("word_uid", "word_str", F.coalesce("s", F.lit(0.0)).alias("stationary"))


def stationary_table(weighted: DataFrame, descending: bool = True) -> DataFrame:
    """The stationary weights with their words, by weight, then word_uid."""
    order = F.desc("stationary") if descending else F.asc("stationary")
    rows = stationary(weighted).join(word_metadata(weighted).select("word_uid", "word"), "word_uid")
    return rows.orderBy(order, "word_uid")


def word_metadata(weighted: DataFrame) -> DataFrame:
    """word_uid, word_str, word of the first row that spells it."""
    first = weighted.groupBy("word_uid", "word_str").agg(F.min_by("word", F.struct("plan_uid", "place")).alias("word"))
    return first.orderBy("word_uid")


def flux(weighted: DataFrame) -> DataFrame:
    """word1, word2, value: sum over shared plans of phi1 phi2 freq, over the weight of word1.

    Only pairs that share a plan have rows. A word that recurs in a plan (without
    dedupe) counts with its last place. A plan holds ``degree`` words at most, so
    the join adds at most degree squared rows for each.
    """
    last = Window.partitionBy("word_uid", "plan_uid").orderBy(F.desc("place"))
    rows = weighted.withColumn("__r", F.row_number().over(last)).where("__r = 1").select("plan_uid", "word_uid", "phi_normalized", "plan_freq")
    a = rows.select("plan_uid", F.col("word_uid").alias("word1"), F.col("phi_normalized").alias("p1"), "plan_freq")
    b = rows.select("plan_uid", F.col("word_uid").alias("word2"), F.col("phi_normalized").alias("p2"))
    pairs = a.join(b, "plan_uid").groupBy("word1", "word2").agg(F.sum(F.col("p1") * F.col("p2") * F.col("plan_freq")).alias("total"))
    weight = stationary(weighted).select(F.col("word_uid").alias("word1"), "stationary")
    return pairs.join(weight, "word1").select("word1", "word2", ratio(F.col("total"), F.col("stationary")).alias("value"))


def flux_labelled(flux_rows: DataFrame, weighted: DataFrame) -> DataFrame:
    """word1_str, word2_str, value."""
    names = weighted.select("word_uid", "word_str").distinct()
    one = names.select(F.col("word_uid").alias("word1"), F.col("word_str").alias("word1_str"))
    two = names.select(F.col("word_uid").alias("word2"), F.col("word_str").alias("word2_str"))
    return flux_rows.join(one, "word1").join(two, "word2").select("word1_str", "word2_str", "value")


def adjacency(flux_rows: DataFrame, undefined: bool = False) -> DataFrame:
    """word1, word2 of positive flux, the diagonal included.

    A word without weight has NaN for flux to the words that share a plan with
    it. Those cells are none here; with ``undefined`` they count, as in SQL,
    where NaN is above all numbers.
    """
    value = F.col("value")
    return flux_rows.where(value > 0 if undefined else positive(value)).select("word1", "word2")


def laplacian(flux_rows: DataFrame, undefined: bool = False) -> DataFrame:
    """word1, word2, value of the non-zero cells: row degree on the diagonal minus adjacency, ``undefined`` as there."""
    near = adjacency(flux_rows, undefined)
    degree = near.groupBy("word1").agg(F.count("*").alias("n"), F.sum((F.col("word1") == F.col("word2")).cast("int")).alias("own"))
    diagonal = degree.select("word1", F.col("word1").alias("word2"), (F.col("n") - F.col("own")).cast("bigint").alias("value"))
    rest = near.where("word1 <> word2").select("word1", "word2", F.lit(-1).cast("bigint").alias("value"))
    return diagonal.where("value <> 0").unionByName(rest)


def spectra(flux_rows: DataFrame, laplacian_rows: DataFrame, num_words: int) -> DataFrame:
    """kind, idx, re, im: eigenvalues of the flux matrix and of the Laplacian.

    The matrices have a row for each word and go to one task as sparse cells. A
    word without weight has a row of NaN, and no other word leads to it: the
    eigenvalues of the other words do not depend on it, and its own are NaN, last.
    """
    one = flux_rows.select(F.lit("flux").alias("kind"), "word1", "word2", F.col("value").cast("double").alias("value"))
    two = laplacian_rows.select(F.lit("laplacian").alias("kind"), "word1", "word2", F.col("value").cast("double").alias("value"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"kind": [], "word1": [], "word2": [], "value": []}), *frames])
        apart = None
        for kind in ("flux", "laplacian"):
            cells = rows[rows["kind"] == kind]
            matrix = np.zeros((num_words, num_words))
            matrix[cells["word1"].astype(int), cells["word2"].astype(int)] = cells["value"]
            apart = undefined_block(matrix) if apart is None else apart
            values = np.sort_complex(np.concatenate([_eigenvalues(matrix[np.ix_(part, part)]) for part in (~apart, apart)]))
            yield pd.DataFrame({"kind": kind, "idx": np.arange(len(values), dtype=np.int32), "re": values.real, "im": values.imag})

    found = one.unionByName(two).repartition(1).mapInPandas(solve, "kind string, idx int, re double, im double")
    # NaN leaves pandas as null.
    return found.select("kind", "idx", *[F.coalesce(n, F.lit(NAN)).alias(n) for n in ("re", "im")])


def undefined_block(matrix: np.ndarray) -> np.ndarray:
    """The rows that lead to a row holding NaN and are led to by one, such rows included.

    No cycle of cells crosses the border, so the eigenvalues of the matrix are
    those of this block and those of the rest.
    """
    start, links = ~np.isfinite(matrix).all(axis=1), matrix != 0

    def spread(links: np.ndarray) -> np.ndarray:
        found = start
        while (more := found | links[:, found].any(axis=1)).sum() > found.sum():
            found = more
        return found

    return spread(links) & spread(links.T)


def _eigenvalues(matrix: np.ndarray) -> np.ndarray:
    if not np.isfinite(matrix).all():
        return np.full(len(matrix), complex(NAN, NAN))
    return np.asarray((np.linalg.eigvalsh if (matrix == matrix.T).all() else np.linalg.eigvals)(matrix), complex)
