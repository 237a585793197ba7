"""Benchmark decontamination by latent semantic retrieval.

Passages (windows of words) are weighted by TF-IDF over hashed words, with the
document frequencies of the whole corpus. A randomised SVD of the benchmark's
passages, whose products with the passage matrix are summed over tasks, gives a
latent basis of fewer dimensions than there are passages. Every window of every
document is projected and compared with every passage by cosine; a candidate
reaches a fifth of the passage's own score, which is loose on purpose: the check
that follows decides. It takes an item for found if the longest common
subsequence of its words with the text covers nearly all of the item, or half of
it together with the item's answer (its last words): a paraphrase.

A window is projected only if it can reach the score at all: each word of the
basis has a largest part in the scores of each group of passages, and the sum of
these parts bounds the window's scores from above. A subsequence is sought only
if the words near the place that the item has, in any order, are enough for it.

Items of few words have no subsequence to speak of; they are found where their
words stand one after the other, and those of very few words where they make a
line of their own.

The benchmark is a query set: it is taken in blocks of bounded size, each block
with its own basis and against all rows. A worker holds one block at a time.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import fresh

BUCKETS = 1 << 17
#: Dimensions of a block's basis as a share of its passages, and at most.
RANK_SHARE, RANK, OVERSAMPLE = 0.65, 256, 16
#: Words of a window: STRIDE times STRIDES.
STRIDE, STRIDES = 8, 3
#: Items of a block, about.
ITEMS = 192
#: Share of a passage's own score from which a window is a candidate.
NEAR = 0.2
COPY, PARAPHRASE = 0.8, 0.5
ANSWER, ANSWER_HOLD = 6, 0.8
#: Items of fewer words are found word for word, and of still fewer as whole lines.
LEAST, LINE = 8, 4
#: Groups of passages whose scores are bounded together.
GROUPS = 16
#: Cosines held at once, and words.
CELLS, WORDS = 1 << 22, 1 << 18

#: Code point ranges (first, last) of scripts without blanks between words.
ALONE = (
    (0xE00, 0xE7F), (0xE80, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x323AF),
)


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Lower-case form of what words are made of (letters, digits, marks on them); else 0."""
    out = ta.lowered().copy()
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] in "NM":
            out[c] = c
    return out


@lru_cache(maxsize=1)
def _alone() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, bool)
    for a, b in ALONE:
        out[a : b + 1] = True
    return out


@dataclass
class Words:
    """Words of a chunk of texts: hash, text, and whether it begins or ends a line."""

    hash: np.ndarray
    doc: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


def words_of(codes: np.ndarray, bounds: np.ndarray) -> Words:
    """Words are runs of letters, digits and their marks, in lower case.

    In scripts that put no blanks between words each character is one.
    """
    n = len(codes)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool))
    low, alone = _folded()[codes], _alone()[codes]
    flags = low > 0
    apart = np.zeros(n + 1, bool)
    apart[bounds[:-1][bounds[:-1] < n]] = True
    apart[1:n] |= alone[1:] | alone[:-1]
    start, end = flags.copy(), flags.copy()
    start[1:] &= ~flags[:-1] | apart[1:n]
    end[:-1] &= ~flags[1:] | apart[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = np.searchsorted(bounds, start, "right") - 1
    line = np.cumsum(codes == 10)[start]
    new = np.ones(len(start) + 1, bool)
    new[1:-1] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    return Words(ta.run_hashes(low, start, end), doc, new[:-1], new[1:])


def windows(doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each stride, and text and first stride of each window.

    Windows begin at every stride of a text; those that only shorten the one
    before are left out.
    """
    count = np.bincount(doc, minlength=n_docs)
    strides = -(-count // STRIDE)
    begin = np.cumsum(count) - count
    owner = np.repeat(np.arange(n_docs), strides)
    first = np.cumsum(strides) - strides
    step = np.arange(len(owner)) - first[owner]
    keep = (step + STRIDES <= strides[owner]) | (step == 0)
    return begin[owner] + step * STRIDE, owner[keep], np.flatnonzero(keep)


def over_windows(parts: np.ndarray, owner_of_stride: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of stride sums over the windows that begin at the given strides."""
    out = parts[first].copy()
    for d in range(1, STRIDES):
        at = np.minimum(first + d, len(parts) - 1)
        same = (first + d < len(parts)) & (owner_of_stride[at] == owner_of_stride[first])
        out[same] += parts[at[same]]
    return out


def places(words: list[int]) -> dict[int, int]:
    """For each word a number with a bit for each of its places."""
    out: dict[int, int] = {}
    for k, x in enumerate(words):
        out[x] = out.get(x, 0) | (1 << k)
    return out


def lcs(a: list[int], b: list[int], where: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, by bits of one large integer."""
    where = places(a) if where is None else where
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = where.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@dataclass
class Basis:
    """Rows of the right singular vectors, times IDF; the last row is zero."""

    row: np.ndarray  # bucket -> row
    table: np.ndarray


@dataclass
class Passages:
    """A block of the benchmark, ready for search."""

    item: np.ndarray  # passage -> item
    at: np.ndarray  # passage -> its first word in the item
    vector: np.ndarray  # passages x rank: unit length over the passage's own score
    own: np.ndarray  # passage -> its score against itself
    most: np.ndarray  # row of the basis x group -> its largest part in the score of a passage of the group
    holds: np.ndarray  # item x row of the basis: 1 if the item has the word, and 2 more if its answer has it
    different: np.ndarray  # item -> such rows of the item, and of its answer
    ids: list
    words: list[list[int]]  # item -> hashes of its words
    where: list[tuple[dict, dict]]  # item -> places of its words, and of its answer's
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # words -> sorted hashes of items so short, and the items
    basis: Basis


def passages_of(words: list[list[int]]) -> tuple[list[list[int]], list[int], list[int]]:
    """Words, item and place of the passages of items; the last one ends with the item."""
    size, out, item, at = STRIDE * STRIDES, [], [], []
    for k, w in enumerate(words):
        starts = [*range(0, max(1, len(w) - size), size), *([len(w) - size] if len(w) > size else [])]
        for a in dict.fromkeys(starts):
            out.append(w[a : a + size])
            item.append(k)
            at.append(a)
    return out, item, at


def verdict(item: list[int], doc: np.ndarray, at: int, where: tuple[dict, dict] | None = None) -> tuple[float, str] | None:
    """Share of an item's words found in order near a place, and the kind of match."""
    slack = int(slack_of(len(item)))
    near = doc[max(0, at - slack) : at + len(item) + slack].tolist()
    answer = item[-ANSWER:]
    whole, last = where or (places(item), places(answer))
    share = lcs(item, near, whole) / len(item)
    if share >= COPY:
        return share, "copy"
    if share >= PARAPHRASE and lcs(answer, near, last) >= ANSWER_HOLD * len(answer):
        return share, "paraphrase"
    return None


def slack_of(size):
    """Words before and after an item's place that are read as well."""
    return np.maximum(STRIDE * STRIDES // 2, size // 4)


def run_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    out = np.full(max(0, len(hashes) - n + 1), n, np.uint64)
    for d in range(n):
        out = ta.mix(out + hashes[d : d + len(out)])
    return out


def _short_hits(w: Words, p: Passages) -> Iterator[tuple[int, int]]:
    """(text, item) of the short items that stand in the texts."""
    for n, (known, item) in p.short.items():
        here = run_of(w.hash, n)
        if not len(here):
            continue
        ok = w.doc[: len(here)] == w.doc[n - 1 :]
        if n < LINE:
            ok &= w.begins[: len(here)] & w.ends[n - 1 :]
        for x in np.flatnonzero(ok & np.isin(here, known)).tolist():
            for k in range(int(np.searchsorted(known, here[x], "left")), int(np.searchsorted(known, here[x], "right"))):
                yield int(w.doc[x]), int(item[k])


def _long_hits(w: Words, p: Passages, idf: np.ndarray, begin: np.ndarray, n_docs: int, near: float) -> Iterator[tuple[int, int, int]]:
    """(text, item, place) of the candidates."""
    none = len(p.basis.table) - 1
    stride_at, owner, first = windows(w.doc, n_docs)
    of_stride = w.doc[stride_at]
    bucket = (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64)
    row = p.basis.row[bucket]
    norm = np.sqrt(over_windows(np.add.reduceat(idf[bucket] ** 2, stride_at), of_stride, first))
    bound = over_windows(np.add.reduceat(p.most[row], stride_at, axis=0), of_stride, first).max(axis=1)
    alive = np.flatnonzero(bound >= near * norm)
    size = np.array([len(w) for w in p.words])
    step = max(1, min(CELLS // len(p.item), WORDS // (STRIDE * STRIDES)))
    for a in range(0, len(alive), step):
        some = alive[a : a + step]
        # Rows of the basis are summed over each stride that a window of these holds.
        lo, hi = first[some[0]], min(first[some[-1]] + STRIDES, len(stride_at))
        used = np.zeros(hi - lo + STRIDES, bool)
        for d in range(STRIDES):
            used[first[some] - lo + d] = True
        used = used[: hi - lo]
        stop = np.append(stride_at[lo + 1 : hi], stride_at[hi] if hi < len(stride_at) else len(row))
        many = (stop - stride_at[lo:hi])[used]
        at = np.cumsum(many) - many
        word = np.arange(int(many.sum())) - np.repeat(at, many) + np.repeat(stride_at[lo:hi][used], many)
        known = np.flatnonzero(row[word] < none)
        sums = np.zeros((len(many), p.vector.shape[1]), np.float32)
        if len(known):
            stride = np.repeat(np.arange(len(many)), many)[known]
            heads = np.flatnonzero(np.append(True, stride[1:] != stride[:-1]))
            sums[stride[heads]] = np.add.reduceat(p.basis.table[row[word[known]]], heads, axis=0)
        place = np.cumsum(used) - 1
        v = over_windows(sums, of_stride[lo:hi][used], place[first[some] - lo])
        hit = v @ p.vector.T >= near * norm[some][:, None]
        x, j = np.nonzero(hit)
        d = owner[some[x]]
        found = np.unique(np.stack([d, p.item[j], stride_at[first[some[x]]] - begin[d] - p.at[j]]), axis=1)
        yield from zip(*found[:, _enough(found, row, begin, size, p)].tolist(), strict=True)


def _enough(found: np.ndarray, row: np.ndarray, begin: np.ndarray, size: np.ndarray, p: Passages) -> np.ndarray:
    """Which candidates have as many of the item's words near their place as a verdict needs."""
    ok = np.zeros(found.shape[1], bool)
    length = size[found[1]]
    slack = slack_of(length)
    lo = np.maximum(begin[found[0]], begin[found[0]] + found[2] - slack)
    hi = np.minimum(begin[found[0] + 1], begin[found[0]] + found[2] + length + slack)
    order = np.argsort(hi - lo, kind="stable")
    for a in range(0, len(order), 1 << 12):
        k = order[a : a + (1 << 12)]
        word = lo[k][:, None] + np.arange(max(0, int((hi - lo)[k].max())))
        near = np.sort(np.where(word < hi[k][:, None], row[np.minimum(word, len(row) - 1)], len(p.basis.table) - 1), axis=1)
        has = p.holds[found[1][k][:, None], near]
        has[:, 1:][near[:, 1:] == near[:, :-1]] = 0
        # What a subsequence can't hold are the different words that aren't there.
        lost = p.different[found[1][k]] - np.stack([(has & 1).sum(axis=1), (has >> 1).sum(axis=1)], axis=1)
        whole, answer = length[k] - lost[:, 0], ANSWER - lost[:, 1]
        ok[k] = (whole >= COPY * length[k]) | (whole >= PARAPHRASE * length[k]) & (answer >= ANSWER_HOLD * ANSWER)
    return ok


def search(texts: list[str | None], blocks: list, idf: np.ndarray, near: float = NEAR) -> list[tuple | None]:
    """For each text: (item_id, similarity, kind, items found), or None.

    blocks: what holds Passages as ``value``; of several, one is held at a time.
    """
    out: list[tuple | None] = [None] * len(texts)
    for k, end, codes, bounds in ta.chunks(texts):
        w = words_of(codes, bounds)
        if not len(w.hash):
            continue
        begin = np.searchsorted(w.doc, np.arange(end - k + 1))
        best: dict[int, list[tuple]] = {}
        for block in blocks:
            p = block.value
            judged: dict[tuple[int, int], tuple[float, str]] = {pair: (1.0, "copy") for pair in _short_hits(w, p)}
            for d, i, at in _long_hits(w, p, idf, begin, end - k, near) if len(p.item) else ():
                got = verdict(p.words[i], w.hash[begin[d] : begin[d + 1]], at, p.where[i])
                if got and got > judged.get((d, i), (0.0, "")):
                    judged[d, i] = got
            for (d, i), (share, kind) in judged.items():
                best.setdefault(d, []).append((-share, p.ids[i], kind))
            if len(blocks) > 1:
                block.__dict__.pop("_value", None)
        for d, items in best.items():
            share, item, kind = min(items)
            out[k + d] = (item, -share, kind, len(items))
    return out


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, over all documents, and their number."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for pdf in frames:
            texts = pdf["__text"].tolist()
            n += len(texts)
            for _, _, codes, bounds in ta.chunks(texts):
                w = words_of(codes, bounds)
                cell = w.doc * BUCKETS + (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64)
                total += np.bincount(np.unique(cell) % BUCKETS, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(total[at], n)})

    got = docs.select(F.col(text_col).alias("__text")).mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[got["bucket"]] = got["n"]
    return out[:-1], int(out[-1])


def _matrix(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, bucket and value of the cells of unit TF-IDF rows, in order of passages."""
    row, bucket, value, n = [], [], [], 0
    for words in words_by_text(texts):
        for part in passages_of([words] if len(words) >= LEAST else [])[0]:
            own = (np.array(list(dict.fromkeys(part)), np.uint64) & np.uint64(BUCKETS - 1)).astype(np.int64)
            if len(own):
                row.append(np.full(len(own), n))
                bucket.append(own)
                value.append(idf[own] / np.sqrt((idf[own] ** 2).sum()))
                n += 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(row), np.concatenate(bucket), np.concatenate(value)


def words_by_text(texts: list[str | None]) -> list[list[int]]:
    out: list[list[int]] = []
    for k, end, codes, bounds in ta.chunks(texts):
        w = words_of(codes, bounds)
        at = np.searchsorted(w.doc, np.arange(end - k + 1))
        out += [w.hash[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    return out


def latent_basis(items: DataFrame, idf: np.ndarray, share: float = RANK_SHARE, most: int = RANK, seed: int = 5) -> Basis:
    """The right singular vectors of the TF-IDF passages of the items' texts.

    items: one column ``text``, a block of the benchmark. With a random X, the
    product A'(A X), and with an orthonormal Q of its range the Gram matrix of
    A Q, are each made in parts by tasks and added up. The rank is a share of the
    number of passages, so that the basis always has fewer dimensions than they.
    """
    spark, width = items.sparkSession, most + OVERSAMPLE
    shared = spark.sparkContext.broadcast(idf)

    def range_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            row, bucket, value = _matrix(pdf["text"].tolist(), shared.value)
            if len(row):
                own, place = np.unique(bucket, return_inverse=True)
                # Random signs that follow from the bucket, so that no table of them is sent.
                cell = own.astype(np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64) + (np.uint64(seed) << np.uint64(40))
                x = np.where(ta.mix(cell) >> np.uint64(63), np.float32(1), np.float32(-1))
                y = np.add.reduceat(x[place] * value[:, None], np.flatnonzero(np.diff(row, prepend=-1)), axis=0)
                total = np.zeros((len(own), width), np.float32)
                np.add.at(total, place, y[row] * value[:, None])
                yield pd.DataFrame({"n": [int(row[-1]) + 1], "bucket": [own.tobytes()], "part": [total.tobytes()]})

    parts = items.mapInPandas(range_of, "n long, bucket binary, part binary").collect()
    rank = min(most, int(np.ceil(share * sum(r["n"] for r in parts))))
    used = np.unique(np.concatenate([np.frombuffer(r["bucket"], np.int64) for r in parts])) if parts else np.zeros(0, np.int64)
    row = np.full(BUCKETS, len(used), np.int64)
    row[used] = np.arange(len(used))
    total = np.zeros((len(used), width))
    for r in parts:
        total[row[np.frombuffer(r["bucket"], np.int64)]] += np.frombuffer(r["part"], np.float32).reshape(-1, width)
    if not len(used):
        return Basis(row, np.zeros((1, 1), np.float32))
    q = np.linalg.qr(total)[0].astype(np.float32)
    second = spark.sparkContext.broadcast((q, row, idf))

    def gram_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, place, weight = second.value
        for pdf in frames:
            row, bucket, value = _matrix(pdf["text"].tolist(), weight)
            if len(row):
                y = np.add.reduceat(q[place[bucket]] * value[:, None], np.flatnonzero(np.diff(row, prepend=-1)), axis=0)
                yield pd.DataFrame({"part": [(y.T @ y).astype(np.float64).tobytes()]})

    gram = sum(np.frombuffer(r["part"]).reshape(q.shape[1], q.shape[1]) for r in items.mapInPandas(gram_of, "part binary").collect())
    value, vector = np.linalg.eigh(gram)
    keep = np.argsort(-value)[:rank]
    table = (q @ vector[:, keep] * idf[used][:, None]).astype(np.float32)
    return Basis(row, np.concatenate([table, np.zeros((1, len(keep)), np.float32)]))


def prepare(rows: list, basis: Basis, idf: np.ndarray) -> Passages:
    """Passages of (item_id, text) rows; items without a word are left out."""
    named = [(item, w) for (item, _), w in zip(rows, words_by_text([t for _, t in rows]), strict=True) if w]
    ids, words = [i for i, _ in named], [w for _, w in named]
    long = [k for k, w in enumerate(words) if len(w) >= LEAST]
    parts, item, at = passages_of([words[k] for k in long])
    vector, own = np.zeros((len(parts), basis.table.shape[1]), np.float32), np.zeros(len(parts), np.float32)
    for k, part in enumerate(parts):
        bucket = (np.array(part, np.uint64) & np.uint64(BUCKETS - 1)).astype(np.int64)
        v = basis.table[basis.row[bucket]].sum(axis=0)
        length = max(np.sqrt((v * v).sum()), 1e-6)
        own[k] = length / max(np.sqrt((idf[bucket] ** 2).sum()), 1e-6)
        vector[k] = v / length / max(own[k], 1e-6)
    n_groups = max(1, min(GROUPS, len(parts)))
    most = np.zeros((len(basis.table), n_groups), np.float32)
    for g in range(n_groups if len(parts) else 0):
        most[:, g] = np.maximum((basis.table @ vector[g::n_groups].T).max(axis=1), 0)
    holds = np.zeros((len(words), len(basis.table)), np.uint8)
    for k in long:
        rows_of = basis.row[(np.array(words[k], np.uint64) & np.uint64(BUCKETS - 1)).astype(np.int64)]
        holds[k, rows_of] = 1
        holds[k, rows_of[-ANSWER:]] = 3
    holds[:, -1] = 0
    different = np.stack([(holds & 1).sum(axis=1), (holds >> 1).sum(axis=1)], axis=1).astype(np.int64)
    short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in sorted({len(w) for w in words if len(w) < LEAST}):
        own_items = np.array([k for k, w in enumerate(words) if len(w) == n])
        hashes = np.array([run_of(np.array(words[k], np.uint64), n)[0] for k in own_items], np.uint64)
        order = np.argsort(hashes, kind="stable")
        short[n] = hashes[order], own_items[order]
    where = [(places(w), places(w[-ANSWER:])) for w in words]
    return Passages(np.array(long, np.int64)[np.array(item, np.int64)], np.array(at, np.int64), vector, own, most * np.float32(1 + 1e-4), holds, different, ids, words, where, short, basis)


HIT = "struct<item_id: bigint, similarity: double, kind: string, n_items: int>"


def finder(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, near: float):
    """A function of a text column that gives the HIT, of null fields for clean texts; null without items."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    n_items = items.count()
    if not n_items:
        return None
    n_blocks = -(-n_items // ITEMS)
    frequency, n = document_frequencies(docs, text_col)
    idf = (np.log((1 + n) / (1 + frequency)) + 0.1).astype(np.float32)
    blocks = []
    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b)
        rows = [(r["id"], r["text"]) for r in block.orderBy("id", "text").collect()]
        blocks.append(sc.broadcast(prepare(rows, latent_basis(block.select("text"), idf), idf)))
    weights = sc.broadcast(idf)

    @F.pandas_udf(HIT)
    def find(texts: pd.Series) -> pd.DataFrame:
        got = [x or (None, None, None, None) for x in search(texts.tolist(), blocks, weights.value, near)]
        out = pd.DataFrame(got, columns=["item_id", "similarity", "kind", "n_items"])
        return out.astype({"item_id": "Int64", "similarity": "float64", "n_items": "Int32"})

    return find.asNondeterministic()


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", into: str = "hit", near: float = NEAR) -> DataFrame:
    """The documents with a column struct(item_id, similarity, kind, n_items), null for clean ones.

    Null and empty texts are clean. Of several items the most similar counts,
    then the smallest id. Items with a null id or text, or without a letter or
    digit, are not looked for; without items every document is clean, and
    without documents there are no rows. Whole texts are searched, in chunks of
    bounded size (one text at least). Repeated rows are marked alike. The
    documents' own columns stay, whatever their names: if they have one named
    like ``into``, the new one is the last, with underscores after its name.
    """
    [name] = fresh(docs, into)
    find = finder(docs, benchmark, text_col, item_col, item_text, near)
    if find is None:
        return docs.withColumn(name, F.lit(None).cast(HIT))
    found = docs.withColumn(name, find(F.col(text_col)))
    return found.withColumn(name, F.when(F.col(name)["item_id"].isNotNull(), F.col(name)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, item_id, similarity, kind, n_items: a row for each contaminated row of the documents."""
    found = mark(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **options)
    return found.where(F.col("hit").isNotNull()).select("doc_id", "hit.item_id", "hit.similarity", "hit.kind", "hit.n_items")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    [name] = fresh(docs, "hit")
    return mark(docs, benchmark, text_col, into=name, **options).where(F.col(name).isNull()).drop(name)
