"""Leading eigenvalues of sparse symmetric cells by a block Krylov iteration.

Vectors are rows of a distributed table, a row for each index with its entries of
all vectors. A step multiplies the last block by the cells (a join and a sum),
takes it against all earlier vectors twice, and makes it orthonormal by the small
Gram matrix that tasks add up from their rows. Only such matrices, whose size is
the number of vectors, come to the driver; there is no matrix of indices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import positive
from ..sources.shared import checkpoint

#: Error of a value at which it counts as found, and vectors at most.
TOLERANCE, MOST = 1e-9, 400
ROW = "i bigint, q array<double>"


def symmetric_flux(flux_rows: DataFrame, stationary_rows: DataFrame) -> DataFrame:
    """i, j, value of the symmetric matrix that has the flux's eigenvalues.

    Flux cells are joint weights over the weight of the first word; scaled by the
    root of both weights instead, the matrix is symmetric and similar.
    """
    z = stationary_rows.select("word_uid", F.col("stationary").alias("z")).where(positive(F.col("z")))
    one, two = z.select(F.col("word_uid").alias("word1"), F.sqrt("z").alias("a")), z.select(F.col("word_uid").alias("word2"), F.sqrt("z").alias("b"))
    cells = flux_rows.where(positive(F.col("value"))).join(one, "word1").join(two, "word2")
    return cells.select(F.col("word1").alias("i"), F.col("word2").alias("j"), (F.col("value") * F.col("a") / F.col("b")).alias("value"))


def leading(cells: DataFrame, k: int, tolerance: float = TOLERANCE, most: int = MOST, seed: int = 0) -> DataFrame:
    """idx, value: the k largest eigenvalues of the symmetric cells (i, j, value), largest first; all, if there are fewer indices.

    Blocks of k vectors find a value as often as it occurs. Indices are those of
    any cell. Not finding the values with ``most`` vectors is an error.
    """
    spark = cells.sparkSession
    cells = checkpoint(cells.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("value").cast("double").alias("value")))
    index = checkpoint(cells.select("i").unionByName(cells.select(F.col("j").alias("i"))).distinct())
    n = index.count()
    if n == 0 or k < 1:
        return spark.createDataFrame([], "idx int, value double")
    block = min(k, n)
    table = _orthonormal(index.select("i", F.array().cast("array<double>").alias("q")), _noise(index, block, seed), 0, block)
    held, size = np.zeros((0, 0)), 0
    while True:
        width = table[1] - size
        # Images of the last block.
        images = cells.join(table[0].select(F.col("i").alias("j"), F.slice("q", size + 1, width).alias("x")), "j")
        sums = F.array(*[F.sum(F.get("x", F.lit(c)) * F.col("value")) for c in range(width)])
        moved = images.groupBy("i").agg(sums.alias("w"))
        both = checkpoint(table[0].join(moved, "i", "left").select("i", "q", F.coalesce("w", F.array_repeat(F.lit(0.0), width)).alias("w")))
        done = table[1]
        products = _gram(both, done + width)[:done, done:]
        grown = np.zeros((done, done))
        grown[:size, :size] = held
        grown[:, size:] = products
        grown[size:, :] = products.T
        held, size = grown, done
        values, vectors = np.linalg.eigh((held + held.T) / 2)
        top = np.argsort(-values)[:block]
        fresh = _orthonormal(both.select("i", "q"), both.select("i", "w"), size, width)
        # What a step leaves outside of the vectors, seen by each leading vector, is the error of its value at most.
        rest = fresh[2]
        error = np.linalg.norm(rest @ vectors[size - width :, top], axis=0).max() if fresh[1] > size else 0.0
        if size >= n or error <= tolerance * max(1.0, np.abs(values).max()):
            return spark.createDataFrame([(k, float(values[t])) for k, t in enumerate(top)], "idx int, value double")
        if fresh[1] == size:  # nothing is left outside: go on from new vectors
            fresh = _orthonormal(both.select("i", "q"), _noise(index, block, seed + size), size, block)
        if fresh[1] > most:
            raise RuntimeError(f"no {k} values within {most} vectors")
        table = fresh


def _noise(index: DataFrame, width: int, seed: int) -> DataFrame:
    """i, w: numbers between -1 and 1 that follow from the index alone."""
    units = [(F.pmod(F.xxhash64("i", F.lit(seed), F.lit(c)), F.lit(1 << 30)) / float(1 << 29) - 1.0) for c in range(width)]
    return index.select("i", F.array(*units).alias("w"))


def _gram(table: DataFrame, size: int) -> np.ndarray:
    """Inner products of all columns of q and w, added up from the tasks' rows."""

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for pdf in frames:
            if len(pdf):
                z = _rows(pdf)
                total += z.T @ z
        yield pd.DataFrame({"at": np.arange(size * size), "v": total.ravel()})

    summed = table.mapInPandas(own, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size * size)
    out[summed["at"]] = summed["v"]
    return out.reshape(size, size)


def _rows(pdf: pd.DataFrame) -> np.ndarray:
    q = np.stack(pdf["q"].to_numpy()) if len(pdf["q"].iloc[0]) else np.zeros((len(pdf), 0))
    return np.hstack([q, np.stack(pdf["w"].to_numpy())])


def _mapped(table: DataFrame, matrix: np.ndarray, keep: int, name: str) -> DataFrame:
    """The rows with q and w times a matrix, as w, or put behind q."""
    shared = table.sparkSession.sparkContext.broadcast(matrix)

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                z = _rows(pdf)
                new = z @ shared.value
                yield pd.DataFrame({"i": pdf["i"], "q": list(z[:, :keep] if name == "w" else np.hstack([z[:, :keep], new])), **({"w": list(new)} if name == "w" else {})})

    return table.mapInPandas(turn, f"{ROW}, w array<double>" if name == "w" else ROW)


def _orthonormal(basis: DataFrame, block: DataFrame, size: int, width: int) -> tuple[DataFrame, int, np.ndarray]:
    """The basis with what the block adds to it, the vectors then, and the block in terms of what it added."""
    table = basis.join(block, "i")
    scale = None
    for _ in range(2):
        gram = _gram(table, size + width)
        away = np.vstack([-gram[:size, size:], np.eye(width)])
        table = checkpoint(_mapped(table, away, size, "w"))
        scale = max(scale or 0.0, float(np.sqrt(np.trace(gram[size:, size:]))))
    gram = _gram(table, size + width)[size:, size:]
    weights, turns = np.linalg.eigh(gram)
    kept = weights > max((1e-10 * scale) ** 2, 1e-24)
    if not kept.any():
        return basis, size, np.zeros((0, width))
    scaled = turns[:, kept] / np.sqrt(weights[kept])
    out = _mapped(table, np.vstack([np.zeros((size, scaled.shape[1])), scaled]), size, "q")
    return checkpoint(out), size + scaled.shape[1], (turns[:, kept] * np.sqrt(weights[kept])).T
