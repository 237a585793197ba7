"""Approximate nearest neighbours by multi-index hashing.

Vectors are centred, turned by learned rotations and cut to signs: a binary code.
The code is split into one-byte substrings, each with an index from its value to
the rows that hold it. If two codes differ in at most r bits, then by the
pigeonhole principle some substring differs in at most its share of r; probing
the values within that share in every index therefore retrieves every code
within the radius. What passes the full Hamming check is reranked on the
original floats.

The rotations and the radius are fitted on a bounded sample; every row is
indexed. Queries are taken in blocks of bounded size, each block against all
rows: a task indexes its rows batch by batch and keeps the k nearest for each
query, so what leaves a task is k rows a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, unit_hash

#: Rows that rotations and radius are fitted on, about; all, if there are fewer.
SAMPLE = 4096
#: Queries in a block, about.
BLOCK = 2048
BITS = 256
K = 10
EVERY = 100
#: Share of the sample's true neighbours that the radius must hold.
HOLD = 0.99
_POP = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int64)
_XOR = _POP[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


@dataclass
class Coder:
    mean: np.ndarray
    turn: np.ndarray  # dimensions x bits
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1)


def fit(x: np.ndarray, bits: int = BITS, k: int = K, hold: float = HOLD, rounds: int = 25, seed: int = 3) -> Coder:
    """Rotations by iterative quantisation, from several starts, and the radius.

    The radius holds all but 1 - hold of the Hamming distances from rows of the
    sample to their true neighbours in it. In all rows true neighbours lie
    nearer than in the sample, so that the radius errs to the safe side.
    """
    rng, d = np.random.default_rng(seed), x.shape[1]
    mean = x.mean(axis=0)
    c = x - mean
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    basis = np.linalg.qr(np.concatenate([vt.T, rng.normal(size=(d, d))], axis=1))[0]
    v = c @ basis
    turns = []
    for _ in range(-(-bits // d)):
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _, wt = np.linalg.svd(np.sign(v @ turn).T @ v)
            turn = (u @ wt).T
        turns.append(basis @ turn)
    coder = Coder(mean, np.concatenate(turns, axis=1)[:, :bits], bits)
    codes = coder.codes(x)
    seen = []
    for q in range(0, len(x), max(1, len(x) // 200)):
        far = ((x - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        near = np.argsort(far, kind="stable")[: min(k, len(x) - 1)]
        seen.append(_POP[codes[near] ^ codes[q]].sum(axis=1))
    spread = np.concatenate(seen) if seen else np.array([bits])
    coder.radius = int(np.quantile(spread, hold)) if len(spread) else bits
    return coder


class Index:
    """Substring indexes of a batch of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, (self.n, self.parts) = codes, codes.shape
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.count = np.stack([np.bincount(codes[:, p], minlength=256) for p in range(self.parts)])
        self.start = np.cumsum(self.count, axis=1) - self.count

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from the given one in at most radius bits.

        With radius = parts * share + rest, a code within the radius agrees up
        to ``share`` bits in one of the first rest + 1 substrings or up to
        ``share - 1`` bits in one of the others.
        """
        share, rest = divmod(radius, self.parts)
        found = np.zeros(self.n, bool)
        for p in range(self.parts):
            probes = np.flatnonzero(_XOR[code[p]] <= share - (p > rest))
            count = self.count[p, probes]
            # The places of all probed values' rows in the index, one after the other.
            place = np.arange(int(count.sum())) + np.repeat(self.start[p, probes] - (np.cumsum(count) - count), count)
            found[self.order[place, p]] = True
        rows = np.flatnonzero(found)
        return rows[_POP[self.codes[rows] ^ code].sum(axis=1) <= radius]


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, one of them not zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def _merge(best: list | None, ids: np.ndarray, far: np.ndarray, k: int):
    """The k nearest of what was kept and what is new, ties to the smaller id."""
    if best is not None:
        ids, far = np.concatenate([best[0], ids]), np.concatenate([best[1], far])
    order = np.lexsort((ids, far))[:k]
    return [ids[order], far[order]]


def _block(rows: DataFrame, queries: list, coder: Coder, k: int) -> DataFrame:
    """query_id, vec_id, score: what each task has nearest to the queries."""
    qid, qx = np.array([r[0] for r in queries], np.int64), np.array([r[1] for r in queries], np.float64)
    radius = np.array([r[2] for r in queries])
    shared = rows.sparkSession.sparkContext.broadcast((qid, qx, coder.codes(qx), radius, coder))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, qx, qcode, radius, coder = shared.value
        best: list = [None] * len(qid)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
            index = Index(coder.codes(x))
            for q in range(len(qid)):
                near = index.within(qcode[q], int(radius[q]))
                if len(near):
                    far = np.sqrt(((x[near] - qx[q]) ** 2).sum(axis=1))
                    # One more than asked for: the query's own row is among them.
                    best[q] = _merge(best[q], ids[near], far, k + 1)
        out = [(qid[q], b) for q, b in enumerate(best) if b is not None]
        if out:
            yield pa.record_batch([
                pa.array(np.repeat([q for q, _ in out], [len(b[0]) for _, b in out])),
                pa.array(np.concatenate([b[0] for _, b in out])),
                pa.array(np.concatenate([b[1] for _, b in out])),
            ], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(search, "query_id long, vec_id long, score double")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, without one row that equals the query in id and vector: its own."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    same = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0)
    found = found.withColumn("place", F.sum(same.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.where(~(same & (F.col("place") == 1)))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K, sample: int = SAMPLE, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance).

    Queries are the rows whose id is divisible by ``every``; a query's own row is
    no candidate (other rows of its id are). Rows with a null id, or a vector that is null, empty, zero or
    not finite, take no part, nor do those of another length than the most
    frequent one. Of a repeated id each row is a candidate; as a query its first
    vector counts (in order of components). A query that finds under k rows
    within the radius is searched again without one. No vectors: no rows. Other
    columns are left, whatever their names; a vector is one value of a row.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.col("id").isNotNull() & usable(F.col("x")))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == lengths["d"])
    drawn = rows if lengths["n"] <= sample else rows.where(unit_hash(F.lit("ann"), F.col("id")) < sample / lengths["n"])
    x = np.array([r["x"] for r in drawn.orderBy("id").collect()], np.float64).reshape(-1, lengths["d"])
    if not len(x):
        x = np.array([rows.first()["x"]], np.float64)
    coder = fit(x, bits, k)
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("x").alias("x"))
    blocks = max(1, -(-asked.count() // block))
    found = None
    for b in range(blocks):
        queries = [(r["id"], r["x"], coder.radius) for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()]
        if not queries:
            continue
        part = checkpoint(_nearest(_block(rows, queries, coder, k), k))
        full = {r["query_id"] for r in part.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, lengths["n"] - 1)).collect()}
        short = [(i, v, coder.turn.shape[1]) for i, v, _ in queries if i not in full]
        if short:
            again = _nearest(_block(rows, short, coder, k), k)
            part = part.where(~F.col("query_id").isin([i for i, _, _ in short])).unionByName(again)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)
