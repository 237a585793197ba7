"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are counted with numpy in chunks of bounded size. The
trees are grown on the driver from the statistics of a bounded sample of
labelled documents, flattened into arrays, and walked for all documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import fold_of, unit_hash

FOLDS, HELD_FOLD = 5, 0
CUT = 0.3
#: Labelled documents that the trees learn from, about; all, if there are fewer.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 80, 4, 64, 0.15, 1.0, 20

STATISTICS = (
    "chars", "words", "letters", "upper", "digits", "marks", "blanks", "other", "word_length", "longest_word",
    "distinct_words", "distinct_pairs", "lines", "distinct_lines", "words_a_line", "marked_words", "upper_words", "top_word", "stops",
)


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of STATISTICS for each text; zeros for null and empty texts."""
    out = np.zeros((len(texts), len(STATISTICS)), np.float32)
    for k, end, codes, bounds in ta.chunks(texts):
        out[k:end] = _of_chunk(codes, bounds)
    return out


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the most frequent one's count, by group."""
    if not len(group):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(g)))
    top = np.zeros(n)
    np.maximum.at(top, g[at], sizes)
    return np.bincount(g[at], minlength=n).astype(float), top


def _of_chunk(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n, starts, ends = len(bounds) - 1, bounds[:-1], bounds[1:]
    out = np.zeros((n, len(STATISTICS)))
    size = (ends - starts).astype(float)
    if not len(codes):
        return out
    kind = ta.classes()[codes]
    some = np.maximum(size, 1)
    flags = {name: (kind & bit) > 0 for name, bit in (("letter", ta.LETTER), ("upper", ta.UPPER), ("digit", ta.DIGIT), ("mark", ta.MARK), ("blank", ta.BLANK))}
    count = {name: ta.sums(x, starts, ends) for name, x in flags.items()}
    ws, we = ta.runs(~flags["blank"], bounds)
    doc = np.searchsorted(bounds, ws, "right") - 1
    words = np.bincount(doc, minlength=n).astype(float)
    any_words = np.maximum(words, 1)
    length = (we - ws).astype(float)
    hashes = ta.run_hashes(codes, ws, we)
    distinct, top = _distinct(doc, hashes, n)
    same = doc[1:] == doc[:-1]
    pairs = ta.mix(hashes[:-1] * np.uint64(3) + hashes[1:])[same] if len(hashes) > 1 else hashes[:0]
    distinct_pairs, _ = _distinct(doc[1:][same], pairs, n)
    ls, le = ta.runs(codes != 10, bounds)
    line_doc = np.searchsorted(bounds, ls, "right") - 1
    lines = np.bincount(line_doc, minlength=n).astype(float)
    distinct_lines, _ = _distinct(line_doc, ta.run_hashes(codes, ls, le), n)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    marked = np.bincount(doc, ta.sums(flags["mark"], ws, we) > 0, minlength=n)
    loud = np.bincount(doc, (ta.sums(flags["upper"], ws, we) == ta.sums(flags["letter"], ws, we)) & (ta.sums(flags["letter"], ws, we) > 1), minlength=n)
    stops = ta.sums(codes == ord("."), starts, ends)
    out[:] = np.stack([
        np.log1p(size), np.log1p(words), count["letter"] / some, count["upper"] / np.maximum(count["letter"], 1), count["digit"] / some,
        count["mark"] / some, count["blank"] / some, (size - count["letter"] - count["digit"] - count["mark"] - count["blank"]) / some,
        np.bincount(doc, length, minlength=n) / any_words, np.log1p(longest), distinct / any_words, distinct_pairs / np.maximum(words - 1, 1),
        np.log1p(lines), distinct_lines / np.maximum(lines, 1), words / np.maximum(lines, 1), marked / any_words, loud / any_words, top / any_words, stops / any_words,
    ], axis=1)
    out[size == 0] = 0
    return out


@dataclass
class Trees:
    """Full binary trees of one depth, laid out level by level."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[0:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = RIDGE, least: int = LEAST) -> Trees:
    """Boost trees on the logistic loss; splits are searched in histograms.

    Without rows, or with one label only, there are no trees and the score is
    the label's share (drawn a little towards a half).
    """
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base, inner, leaves = float(np.log(share / (1 - share))), 2**depth - 1, 2**depth
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    margin = np.full(len(y), base)
    out = Trees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            wide, first = 2**level, 2**level - 1
            best, choice = np.zeros(wide), [(0, -1)] * wide
            for f, c in enumerate(cuts):
                at = (node - first) * bins + binned[f]
                gs, hs, ns = (np.cumsum(np.bincount(at, w, wide * bins).reshape(wide, bins), axis=1) for w in (g, h, None))
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(ns < least) | (nt - ns < least)] = 0
                gain = gain[:, : len(c)]
                if not gain.shape[1]:
                    continue
                pick = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(wide), pick] > best + 1e-9):
                    best[k], choice[k] = gain[k, pick[k]], (f, int(pick[k]))
            feature, cut = (np.array(v) for v in zip(*choice, strict=True))
            real = cut >= 0
            out.feature[t, first : first + wide] = feature
            out.threshold[t, first : first + wide] = [cuts[f][c] if c >= 0 else np.inf for f, c in choice]
            own = node - first
            node = 2 * node + 1 + (real[own] & (binned[feature[own], np.arange(len(y))] > cut[own]))
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        out.leaf[t] = -rate * gs / (hs + ridge)
        margin += out.leaf[t][leaf]
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = FOLDS, held: int = HELD_FOLD, most: int = TRAIN_ROWS) -> Trees:
    """Learn from labelled documents outside the held-out fold.

    The documents are drawn by a hash of their id so that about ``most`` are
    taken (all, if there are fewer). Their statistics come to the driver: a few
    numbers for each. Rows with a null id or label teach nothing; of several
    labels of a document the largest counts.
    """
    key = F.col(id_col)
    named = labels.select(key.alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y is not null")
    named = named.where(fold_of(F.col("__id"), folds) != held).groupBy("__id").agg(F.max("__y").alias("__y"))
    n = named.count()
    if n > most:
        named = named.where(unit_hash(F.lit("quality"), F.col("__id")) < most / n)
    rows = docs.select(key.alias("__id"), F.col(text_col).alias("__text")).join(named, "__id").select("__text", "__y")
    schema = "y int, " + ", ".join(f"{c} float" for c in STATISTICS)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = pd.DataFrame(statistics(pdf["__text"].tolist()), columns=list(STATISTICS))
            x.insert(0, "y", pdf["__y"].to_numpy())
            yield x

    got = rows.mapInPandas(count, schema).toPandas().sort_values(list(STATISTICS)).to_numpy(np.float64)
    return grow(got[:, 1:], (got[:, 0] > 0).astype(float))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held: int = HELD_FOLD, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts score as texts whose statistics are all zero. A null id
    is not held out. Repeated rows are scored alike. The statistics of a long text
    are counted in one chunk of its own. No documents: no rows. Other columns are
    left, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(statistics(texts.tolist()).astype(np.float64)))

    key = F.col(id_col)
    rows = docs.select(key.alias("doc_id"), F.coalesce(fold_of(key, folds) == held, F.lit(False)).alias("held_out"), scored(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cut).cast("int"))
