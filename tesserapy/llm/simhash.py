"""SimHash near-dedup with pigeonring filtering.

A text's fingerprint has 64 bits; two fingerprints link at ``RADIUS`` differing
bits or fewer. The bits lie in a ring of ``RADIUS + 1`` segments. If two
fingerprints differ in at most r bits, then by the pigeonring principle there is
a segment from which every chain of l consecutive segments holds at most
``l * r / segments`` differences. The first two links of the chain make the key
of the candidate join (one segment equal, at most one difference in the next);
the longer chains prune candidates before the full Hamming check.

Only distinct fingerprints are joined. Within a key the links found are a
spanning forest, never all pairs, and the components are found by alternating
star contractions over DataFrames, each round written to the shared folder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, checkpoint, fresh, parted
from .textarrays import mix

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
#: Pairs within a key are compared in blocks of about this many.
BLOCK = 1 << 18

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = re.compile(WORD.encode())


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint, unsigned; 0 for null and for texts without a word."""
    words = _WORDS.findall(text.encode("utf-8", "replace").translate(_LOWER)) if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    starts = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    votes = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 15):
        part = hashes[k : k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def word_fingerprint(text: str | None, seed: int) -> int:
    """The 64-bit fingerprint of a text's distinct words, unsigned; 0 without a word.

    A frequent word counts as little as a rare one, so that texts of one language
    lie far apart and copies with a few changed words close together.
    """
    words = set(_WORDS.findall(text.encode("utf-8", "replace").translate(_LOWER))) if text else set()
    if not words:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def jaccard(a: str | None, b: str | None, shingle: int) -> float:
    """Similarity of the sets of word shingles (the whole text, if it has fewer words)."""
    sets = []
    for text in (a, b):
        words = _WORDS.findall((text or "").encode("utf-8", "replace").translate(_LOWER))
        sets.append({tuple(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else set())
    both = len(sets[0] & sets[1])
    union = len(sets[0]) + len(sets[1]) - both
    return both / union if union else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    @F.pandas_udf(T.LongType())
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col)).alias("fp"))


def segments(radius: int = RADIUS) -> list[tuple[int, int]]:
    """(first bit, end) of each of the radius + 1 segments."""
    n = radius + 1
    edges = [round(k * BITS / n) for k in range(n + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _mask(segs: list[tuple[int, int]], which: list[int]) -> int:
    out = 0
    for k in which:
        a, b = segs[k % len(segs)]
        out |= ((1 << (b - a)) - 1) << a
    return out


def key_masks(radius: int = RADIUS) -> list[int]:
    """For each bit: its segment and the one before it, without the bit itself."""
    segs = segments(radius)
    out = []
    for k, (a, b) in enumerate(segs):
        out += [_mask(segs, [k - 1, k]) & ~(1 << bit) for bit in range(a, b)]
    return out


def chain_masks(radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """For each bit: (mask, most differences) of the longer chains from its key."""
    segs, n = segments(radius), radius + 1
    out = []
    for k, (a, b) in enumerate(segs):
        chains = [(_mask(segs, list(range(k - 1, k - 1 + m))), m * radius // n) for m in range(3, n + 1)]
        out += [chains] * (b - a)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(values: np.ndarray, radius: int, chains: list[tuple[int, int]] = ()) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is within the radius, in a run of equal keys.

    As in short runs, a pair counts only if each chain from the run's key holds
    few enough differences, which prunes before the full Hamming check; every
    link passes in the run of one of its keys, so none is lost.

    Breadth first from each value in turn, those nearest to the run's centre (the
    majority of each bit) first: what a value reaches leaves the list of those
    not yet reached, so a dense group costs little over its size, and hangs on
    the value that its members are copies of, if that is there. Each value joins
    the nearest of those that reach it.
    """
    bits = np.zeros(BITS, np.int64)
    for k in range(0, len(values), 1 << 15):
        part = np.ascontiguousarray(values[k : k + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    centre = np.packbits(2 * bits > len(values), bitorder="little").view(np.uint64)[0]
    out, rest = [], values[np.argsort(np.bitwise_count(values ^ centre), kind="stable")]
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            new = []
            step = max(1, BLOCK // max(1, len(rest)))
            for k in range(0, len(front), step):
                diff = front[k : k + step, None] ^ rest[None, :]
                ok = np.ones(diff.shape, bool)
                for mask, limit in chains:
                    ok &= np.bitwise_count(diff & np.uint64(mask)) <= limit
                gap = np.where(ok, np.bitwise_count(diff), np.uint8(BITS + 1))
                nearest = gap.argmin(axis=0)
                hit = gap[nearest, np.arange(len(rest))] <= radius
                if hit.any():
                    out.append((front[k + nearest[hit]], rest[hit]))
                    new.append(rest[hit])
                    rest = rest[~hit]
                    if not len(rest):
                        break
            front = np.concatenate(new) if new else rest[:0]
    return out


def _run_links(slot: np.ndarray, key: np.ndarray, fp: np.ndarray, radius: int, chains: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within runs of equal (slot, key) in sorted columns."""
    new = np.ones(len(fp), bool)
    new[1:] = (key[1:] != key[:-1]) | (slot[1:] != slot[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fp)))
    small, most = (sizes > 1) & (sizes <= 24), 0
    if small.any():
        most = int(sizes[small].max())
        run_end = np.repeat(starts + sizes, sizes)
        ok = np.repeat(small, sizes)
        masks = np.array([[c[0] for c in x] for x in chains], np.uint64)
        limits = np.array([[c[1] for c in x] for x in chains], np.int64)
        for d in range(1, most):
            i = np.flatnonzero(ok & (np.arange(len(fp)) + d < run_end))
            if not len(i):
                break
            diff = fp[i] ^ fp[i + d]
            for c in range(masks.shape[1]):
                keep = np.bitwise_count(diff & masks[slot[i], c]) <= limits[slot[i], c]
                i, diff = i[keep], diff[keep]
            if len(i):
                yield fp[i], fp[i + d]
    for s, n in zip(starts[sizes > 24], sizes[sizes > 24], strict=True):
        yield from _forest(fp[s : s + n], radius, chains[slot[s]][:-1])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links whose connected components are those of all links.

    distinct: one column ``fp`` without repeats. Every fingerprint is sent to a
    key for each of its bits; rows of a task come sorted by key and are read as
    a stream, so no more than one run of equal keys is held at a time. Runs of up
    to 24 give all their links, larger ones a spanning forest. Only the slot and
    the fingerprint are shuffled; the key follows from them.
    """
    masks, chains = [_signed(m) for m in key_masks(radius)], chain_masks(radius)
    key = F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("slot") + 1))
    rows = distinct.select(F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("slot"), "fp")
    rows = rows.repartition("slot", key).sortWithinPartitions("slot", key)
    keep = np.array(masks, np.int64)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def find(parts, last):
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            slot, key, fp = cols[0], cols[1], cols[2].view(np.uint64)
            cut = len(fp)
            if not last:
                same = (slot == slot[-1]) & (key == key[-1])
                cut = len(fp) - int(same[::-1].argmin() if not same.all() else len(fp))
            a, b = [], []
            for x, y in _run_links(slot[:cut], key[:cut], fp[:cut], radius, chains):
                a.append(x)
                b.append(y)
            rest = [c[cut:] for c in cols] if cut < len(fp) else None
            if not a:
                return rest, None
            pair = np.stack([np.concatenate(a), np.concatenate(b)]).view(np.int64)
            pair = np.unique(np.sort(pair, axis=0), axis=1)
            return rest, pa.record_batch([pa.array(pair[0]), pa.array(pair[1])], schema=schema)

        # ``held`` is joined only when a new run begins, so a long run costs one copy.
        for batch in batches:
            if not batch.num_rows:
                continue
            slot, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            cols = [slot, fp & keep[slot], fp]
            goes_on = held and cols[0][-1] == held[0][0][0] and cols[1][-1] == held[0][1][0]
            held.append(cols)
            if goes_on:
                continue
            rest, made = find(held, False)
            held = [rest] if rest is not None else []
            if made is not None:
                yield made
        if held:
            _, made = find(held, True)
            if made is not None:
                yield made

    return rows.mapInArrow(scan, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of all nodes on a link.

    Alternating contractions: each node hands its larger neighbours to the
    smallest one it knows (large star), then its smaller ones (small star), until
    nothing changes. A hub costs a row for each neighbour, never a list. A round
    never has more rows than the links, so nothing is made distinct before the end.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.uint64(0)
        for batch in batches:
            u, v = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
            n, total = n + len(u), total + mix(mix(u) + v).sum(dtype=np.uint64)
        yield pa.record_batch([pa.array([n]), pa.array([int(total) >> 1])], names=["n", "total"])

    pairs = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = checkpoint(small)
        parts = pairs.mapInArrow(tally, "n long, total long").collect()
        now = sum(r["n"] for r in parts), sum(r["total"] for r in parts)
        if now == before:
            break
        before = now
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))
    return pairs.select(F.inline(ends)).distinct()


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for every row of the documents.

    component_id is the smallest doc_id reachable over links, itself included.
    Null and empty texts have fingerprint zero and link like any other. Rows
    with a null id are returned; they give no id to their component, whose id is
    null if it has no other row. Repeated rows are returned as often as they come.
    A long text is a chunk of its own. No documents: no rows. Other
    columns are left, whatever their names.
    """
    marked = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    groups = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("__least")))
    nodes = checkpoint(components(links(groups.select("fp"), radius)))
    joined = groups.join(nodes, groups["fp"] == nodes["node"], "left").select("fp", "__least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("__least").alias("component_id"))
    named = joined.join(least, "root").select(F.col("fp").alias("__fp"), "component_id")
    return marked.join(named, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


#: Seeds of the fingerprints that propose near copies.
SEEDS = (42,)
NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: Shingles in so many texts come last in the order of shingles, and the most that are ordered so.
COMMON, ORDERED = 32, 1 << 19
#: Shingles counted at once.
COUNTED = 1 << 21
#: Runs of a shingle up to this long give all their pairs at once; of longer ones so many heads go first.
SHORT, HEADS = 24, 4
#: Words of 64 bits in a parity sketch, and their columns.
SKETCH = 8
PARITY = [f"s{k}" for k in range(SKETCH)]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles (the whole text, if it has fewer words)."""
    words = _WORDS.findall(text.encode("utf-8", "replace").translate(_LOWER)) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest, k = xxhash.xxh64_intdigest, min(shingle, len(words))
    return _shingled(np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words)), k)


def _shingled(one: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of each k consecutive words, from the words' hashes."""
    n = len(one) - k + 1
    out = np.full(n, k, np.uint64)
    for d in range(k):
        out = (out ^ one[d : d + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def near_marks(text: str | None, shingle: int, seeds=SEEDS) -> list[int]:
    """The fingerprints of a text's distinct words under each seed, its parity sketch, and its number of shingles.

    Bit b of the sketch is the parity of the distinct shingles whose hash falls on
    b, so two sketches differ in no more bits than the sets in shingles.
    """
    words = _WORDS.findall(text.encode("utf-8", "replace").translate(_LOWER)) if text else []
    if not words:
        return [0] * (len(seeds) + SKETCH + 1)
    out, digest, distinct = [], xxhash.xxh64_intdigest, list(set(words))
    for seed in seeds:
        hashes = np.fromiter((digest(w, seed) for w in distinct), np.uint64, len(distinct))
        if seed == SEED:
            known = dict(zip(distinct, hashes.tolist(), strict=True))
        votes = np.zeros(BITS, np.int64)
        for k in range(0, len(hashes), 1 << 15):
            part = hashes[k : k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
            votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0]))
    if SEED not in seeds:
        known = {w: digest(w, SEED) for w in distinct}
    own = _shingled(np.fromiter((known[w] for w in words), np.uint64, len(words)), min(shingle, len(words)))
    odd = np.bincount((own >> np.uint64(33)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return [*out, *np.packbits(odd.astype(bool), bitorder="little").view(np.int64).tolist(), len(own)]


def _least_overlap(total, similarity: float):
    """Shared shingles that two texts of so many shingles together need."""
    return np.ceil(similarity / (1 + similarity) * total - 1e-6)


def _may_reach(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sizes and places (``at``) of a shared shingle leave room for the similarity.

    At the first shingle that a pair shares it is never wrongly false.
    """
    n, m = x >> 32, y >> 32
    left = np.minimum(n - (x & 0xFFFFFFFF), m - (y & 0xFFFFFFFF))
    return (left >= _least_overlap(n + m, similarity)) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6)


def common_shingles(docs: DataFrame, shingle: int, least: int = COMMON, most: int = ORDERED) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many texts, sorted, and about how many texts hold them.

    Only the order of shingles depends on them, never which pairs are found: a
    shingle is counted where it repeats among texts that are read together.
    docs: one column of texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def counted():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(token[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and hash(text) not in seen:
                    seen.add(hash(text))
                    held.append(shingle_hashes(text, shingle))
                    size += len(held[-1])
                    if size >= COUNTED:
                        yield counted()
                        held, size, seen = [], 0, set()
        if held:
            yield counted()

    total = checkpoint(docs.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    limits = [least << k for k in range(32)]
    sizes = total.agg(*[F.count(F.when(F.col("n") >= x, 1)).alias(str(x)) for x in limits]).first()
    limit = next((x for x, n in zip(limits, sizes, strict=True) if n <= most), limits[-1])
    got = total.where(F.col("n") >= limit).toPandas()
    token, n = got["token"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(token)
    return token[order], n[order]


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted rows, in parts that hold whole runs of the first column."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        goes_on = held and cols[0][-1] == held[0][0][0]
        held.append(cols)
        if goes_on:
            continue
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        held = [[c[cut:] for c in cols]]
        if cut:
            yield [c[:cut] for c in cols]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def shared_prefixes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """token, k, at, long: the prefix shingles that several texts have.

    docs: k (a hash of the text), text. Shingles have one order everywhere, those
    of many texts last. Two texts of the similarity share a shingle among the
    first ``n - ceil(similarity * n) + 1`` of the n of each (prefix filtering).
    at: n times 2**32, plus the place of the shingle. In runs up to SHORT texts,
    those that can reach no other one from the shingle are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs.select("text"), shingle))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = shared.value
        for batch in batches:
            token, key, at, seen = [], [], [], set()
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k in seen:
                    continue
                seen.add(k)
                own = shingle_hashes(text, shingle)
                n = len(own)
                if not n:
                    continue
                if len(common):
                    place = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    own = own[np.argsort(np.where(common[place] == own, often[place], 0), kind="stable")]
                m = n - int(np.ceil(similarity * n - 1e-6)) + 1
                token.append(own[:m])
                key.append(np.full(len(token[-1]), k, np.int64))
                at.append((n << 32) + np.arange(len(token[-1]), dtype=np.int64))
            if token:
                yield pa.record_batch([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(key)), pa.array(np.concatenate(at))], names=["token", "k", "at"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, key, at in _whole_runs(batches):
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            token, key, at = token[new], key[new], at[new]
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            sizes = np.diff(np.append(starts, len(token)))
            long = np.repeat(sizes > SHORT, sizes)
            keep = long.copy()
            end = np.where(long, 0, np.repeat(starts + sizes, sizes))
            i = np.flatnonzero(end)
            for d in range(1, SHORT):
                i = i[i + d < end[i]]
                if not len(i):
                    break
                ok = i[_may_reach(at[i], at[i + d], similarity)]
                keep[ok] = keep[ok + d] = True
            if keep.any():
                yield pa.record_batch([pa.array(x[keep]) for x in (token, key, at, long)], names=["token", "k", "at", "long"])

    rows = docs.select("k", "text").mapInArrow(prefix, "token long, k long, at long")
    return rows.repartition("token").sortWithinPartitions("token", "k").mapInArrow(repeated, "token long, k long, at long, long boolean")


def prefix_pairs(held: DataFrame, similarity: float, heads: bool) -> DataFrame:
    """a, b: pairs of texts of different roots that may have the similarity.

    held: token, k, at, root and the parity sketch. Pairs whose sizes, whose places
    of the shingle, or whose sketches rule the similarity out are left: texts of n
    and m shingles that differ in d have (n + m - d) / (n + m + d). With heads,
    only pairs with a few members of each long run; else all pairs, without
    exception.
    """

    def fit(at, root, i, j):
        return (root[i] != root[j]) & _may_reach(at[i], at[j], similarity)

    def alike(at, sketch, i, j):
        apart = sum(np.bitwise_count((s[i] ^ s[j]).view(np.uint64)).astype(np.int64) for s in sketch)
        return apart * (1 + similarity) <= ((at[i] >> 32) + (at[j] >> 32)) * (1 - similarity) + 1e-6

    def out(a, b):
        pair = np.unique(np.sort(np.stack([a, b]), axis=0), axis=1)
        return pa.record_batch([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, key, at, root, *sketch in _whole_runs(batches):
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            sizes = np.diff(np.append(starts, len(token)))
            mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
            small = mixed & (sizes <= SHORT)
            if small.any() and not heads:
                end = np.repeat(np.where(small, starts + sizes, 0), sizes)
                i = np.flatnonzero(end)
                for d in range(1, int(sizes[small].max())):
                    i = i[i + d < end[i]]
                    ok = i[fit(at, root, i, i + d)]
                    ok = ok[alike(at, sketch, ok, ok + d)]
                    if len(ok):
                        yield out(key[ok], key[ok + d])
            for s, n in zip(starts[mixed & ~small].tolist(), sizes[mixed & ~small].tolist(), strict=True):
                rest = np.arange(s, s + n)
                # Other heads in each run, so that a text meets many of its family.
                front = rest[np.argsort((key[rest] ^ token[s]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")][:HEADS] if heads else rest
                step = max(1, BLOCK // n)
                for k in range(0, len(front), step):
                    x, y = np.nonzero(fit(at, root, front[k : k + step, None], rest[None, :]))
                    x, y = front[k + x], rest[y]
                    if not heads:
                        x, y = x[y > x], y[y > x]
                    ok = alike(at, sketch, x, y)
                    if ok.any():
                        yield out(key[x[ok]], key[y[ok]])

    return held.repartition("token").sortWithinPartitions("token").select("token", "k", "at", "root", *PARITY).mapInArrow(scan, "a long, b long").distinct()


def _near_texts(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, radius: int, seeds) -> tuple[DataFrame, DataFrame]:
    """Each row's doc_id, k1, k2; and k1, k2, lead, root of each different text."""
    names = [f"fp{x}" for x in seeds]

    marks_of = [*names, *PARITY, "size"]

    @F.pandas_udf(", ".join(f"{c} long" for c in marks_of))
    def marks(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(np.array([near_marks(t, shingle, seeds) for t in texts], np.int64).reshape(-1, len(marks_of)), columns=marks_of)

    @F.pandas_udf("double")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y, shingle) for x, y in zip(a, b, strict=True)], dtype=float)

    marked = docs.select(F.col(id_col).alias("doc_id"), *_text_keys(text_col), marks.asNondeterministic()(F.col(text_col)).alias("of"))
    marked = checkpoint(marked.select("doc_id", "k1", "k2", "of.*"))
    texts = marked.groupBy("k1", "k2").agg(F.min("doc_id").alias("lead"), *[F.first(n).alias(n) for n in marks_of])
    texts = checkpoint(texts.withColumn("node", F.monotonically_increasing_id()))
    side = F.struct("node", "k1", "k2", "size", *PARITY)
    found = None
    for name in names:
        group = checkpoint(texts.groupBy(F.col(name).alias("fp")).agg(F.min(side).alias("head")))
        one, two = group.select(F.col("fp").alias("a"), F.col("head").alias("x")), group.select(F.col("fp").alias("b"), F.col("head").alias("y"))
        far = links(group.select("fp"), radius).join(one, "a").join(two, "b").select("x", "y")
        same = texts.select(side.alias("y"), F.col(name).alias("fp")).join(group, "fp").where("y.node <> head.node").select(F.col("head").alias("x"), "y")
        part = far.unionByName(same)
        found = part if found is None else found.unionByName(part)
    # Parities that differ are shingles that differ, so these rule the similarity out.
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in PARITY])
    found = found.where(apart * (1 + similarity) <= (F.col("x.size") + F.col("y.size")) * (1 - similarity) + 1e-6)
    brief = [F.struct(*[F.col(f"{c}.{n}").alias(n) for n in ("node", "k1", "k2")]).alias(c) for c in "xy"]
    pairs = checkpoint(found.select(*brief) if len(names) == 1 else found.select(*brief).distinct())

    def good(pairs: DataFrame) -> DataFrame:
        """a, b: nodes of the pairs that have the similarity."""
        wanted = checkpoint(pairs.select(F.inline(F.array("x", "y"))).distinct())
        # Only texts that may be wanted are shuffled, equal ones of a task once.
        some, _ = parted(docs.select(*_text_keys(text_col), F.col(text_col).alias("text")), F.col("k1"), wanted.select("k1"))
        held = checkpoint(some.dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"]).select("node", "text"))
        left, right = held.select(F.col("node").alias("a"), F.col("text").alias("one")), held.select(F.col("node").alias("b"), F.col("text").alias("two"))
        both = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).join(left, "a").join(right, "b")
        return checkpoint(both.where(compare("one", "two") >= similarity).select("a", "b"))

    roots = checkpoint(components(good(pairs)))
    runs = checkpoint(shared_prefixes(docs.select(_text_keys(text_col)[0].alias("k"), F.col(text_col).alias("text")), shingle, similarity))
    for heads in (True, False):
        home = texts.join(roots, "node", "left").select(F.col("k1").alias("k"), F.coalesce("root", "node").alias("root"), *PARITY)
        more = prefix_pairs((runs.where("long") if heads else runs).join(home, "k"), similarity, heads)
        one, two = (texts.select(F.col("k1").alias(k), F.struct("node", "k1", "k2").alias(n)) for k, n in (("a", "x"), ("b", "y")))
        edges = good(checkpoint(more.join(one, "a").join(two, "b").select("x", "y")))
        # What is known of the groups stands for the links that they came from.
        roots = checkpoint(components(edges.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))))
    return marked, texts.join(roots, "node", "left").select("k1", "k2", "lead", F.coalesce("root", "node").alias("root"))


def _text_keys(text_col: str) -> list:
    return [F.xxhash64(F.lit(k), F.coalesce(F.col(text_col), F.lit(""))).alias(f"k{k}") for k in (1, 2)]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, seeds=SEEDS) -> DataFrame:
    """doc_id, group_id (the smallest id of the group) for every id.

    Texts are near copies if the Jaccard similarity of their five-word shingles
    is ``similarity`` or more; groups are the components over all such pairs.
    First come candidates by fingerprints of the distinct words under each of the
    seeds, linked at ``radius`` bits as elsewhere here, which join most of a
    family at little cost. Prefix filtering then proposes every other pair of
    texts not yet in one group that can have the similarity. Every candidate is
    compared exactly. Equal texts are one group; so are all texts without a word,
    null ones included. Null ids are one id. A long text is one value of a row, and
    its shingles one array. No documents: no rows. Other columns are left, whatever
    their names.
    """
    marked, texts = _near_texts(docs, id_col, text_col, shingle, similarity, radius, seeds)
    least = texts.groupBy("root").agg(F.min("lead").alias("group_id"))
    named = texts.join(least, "root").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "group_id")
    joined = marked.join(named, (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2")))
    return joined.select("doc_id", "group_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, one of each group of near copies: the one with the smallest id.

    Rows that agree in id and text are one document. Different texts under one id,
    or without an id, are documents of their own; a null id comes after all others,
    and of texts with equal ids a hash of the text decides. Null texts, texts without
    a word and long texts are as in ``near_groups``. Columns stay, whatever their
    names. No documents: no rows.
    """
    marked, texts = _near_texts(docs, id_col, text_col, **{"shingle": NEAR_SHINGLE, "similarity": SIMILARITY, "radius": RADIUS, "seeds": SEEDS, **options})
    first = F.min(F.struct(F.col("lead").isNull().alias("none"), "lead", "k1", "k2")).alias("first")
    keep = checkpoint(texts.groupBy("root").agg(first).select(F.col("first.lead").alias("id"), F.col("first.k1").alias("one"), F.col("first.k2").alias("two")))
    # Documents that go, and rows that repeat: only what may be one of these is shuffled.
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("k1") == F.col("one")) & (F.col("k2") == F.col("two"))
    open_ = marked.groupBy("doc_id", "k1", "k2").agg(F.count("*").alias("n")).join(keep, same, "left").where("n > 1 or one is null")
    key, one, two, d1, d2 = fresh(docs, "id", "one", "two", "d1", "d2")
    keyed = docs.withColumns(dict(zip((d1, d2), _text_keys(text_col), strict=True)))
    some, whole = parted(keyed, F.xxhash64(F.col(id_col), F.col(d1), F.col(d2)), open_.select(F.xxhash64("doc_id", "k1", "k2").alias("key")))
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.col(d1) == F.col(one)) & (F.col(d2) == F.col(two))
    some = some.join(keep.toDF(key, one, two), same, "left_semi").dropDuplicates([id_col, d1, d2])
    return whole.unionByName(some).drop(d1, d2)


def hex_fingerprints(clustered: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 lowercase hex digits, component_id."""
    return clustered.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
