"""Exact substring dedup by suffix arrays.

Bytes that lie in a string of ``LENGTH`` bytes which also starts anywhere else
are removed. Every such string (window) holds grams of ``GRAM`` bytes; the
leftmost gram of smallest hash is its anchor, and equal windows have equal
anchors at the same place. A document is so cut into segments, each the union of
consecutive windows with one anchor, and windows can only be equal in segments
of equal anchors. Segments are brought together by the anchor's hash:

* a segment that occurs twice as a whole is covered at once; within a batch of
  documents that is found before anything is shuffled, so a segment that very
  many documents share costs a row for each batch. Likewise only one segment of
  an anchor and batch is dealt by the anchor: the batch's others know already
  that they share it, and are dealt by their own hash;
* segments that share only their anchor go to a suffix array, built by linear
  grouping (``gsaca``) over symbols of eight bytes counted from the anchor. Runs
  of suffixes that agree in 24 symbols give classes; a window is a class and
  eight bytes around it, so equal windows are found to the byte;
* where very many different segments share an anchor, each is halved: a window
  reaches far to the left of the anchor or far to the right, so one half is keyed
  by the bytes before the anchor as well and the other by those after it. Halves
  that are equal are covered as wholes, and keys that are still too large are
  halved again, until a key is a whole window. So no group has to fit a task
  that is larger than the bound, and all of them end in a suffix array.

Removal is judged on the input; documents meet their covered ranges in one join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, parted
from .gsaca import suffix_array
from .textarrays import mix

LENGTH = 200
GRAM = 64
SYMBOL = 8
#: Bytes scanned at once; longer texts are scanned in pieces that overlap.
PIECE = 1 << 20
#: Different segments of one key that a suffix array takes; keys of more are made finer.
MOST_IN_TASK = 2_000
#: Symbols of a suffix array, about.
ARRAY_SYMBOLS = 150_000

_STEP = 0x9E3779B97F4A7C15
_PLACE_BITS = 21


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.cumprod(np.full(n - 1, base, np.uint64))
    return out


class Scanner:
    """Finds the segments of texts; keeps its tables of powers between calls."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE):
        self.length, self.gram, self.piece, self.width = length, gram, piece, length - gram + 1
        n = piece + length + 1
        self.up, self.down = _powers(_STEP, n), _powers(pow(_STEP, -1, 1 << 64), n)

    def pieces(self, offsets: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of (text, first byte in it, bytes), each of about a piece together."""
        held, size = [], 0
        for k, n in enumerate(np.diff(offsets).tolist()):
            if n < self.length:
                continue
            for a in range(0, n - self.length + 1, self.piece - self.length):
                m = min(n - a, self.piece - 1)
                if held and size + m > self.piece:
                    yield held
                    held, size = [], 0
                held.append((k, a, m))
                size += m
        if held:
            yield held

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """text, start, anchor's offset from it, windows, anchor hash, segment hash."""
        for held in self.pieces(offsets):
            text, first, size = (np.array(x, np.int64) for x in zip(*held, strict=True))
            buf = np.concatenate([data[offsets[k] + a : offsets[k] + a + m] for k, a, m in held])
            yield self._scan(buf, text, first, size)

    def _scan(self, buf, text, first, size):
        n, w, gram = len(buf), self.width, self.gram
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        hashes = mix((total[gram:] - total[:-gram]) * self.down[: n - gram + 1])
        packed = (hashes & np.uint64(~((1 << _PLACE_BITS) - 1) & (2**64 - 1))) | np.arange(n - gram + 1, dtype=np.uint64)
        place = (_sliding_min(packed, w) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        begin = np.cumsum(size) - size
        valid = np.zeros(n + 1, np.int64)
        np.add.at(valid, begin, 1)
        np.add.at(valid, begin + size - self.length + 1, -1)
        starts = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
        anchor = place[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        s, run, a = starts[at], np.diff(np.append(at, len(starts))), anchor[at]
        e = s + run - 1 + self.length
        whole = mix(mix((total[e] - total[s]) * self.down[s]) + (e - s).astype(np.uint64))
        own = np.searchsorted(begin, s, "right") - 1
        return text[own], s - begin[own] + first[own], a - s, run, hashes[a], whole


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, from running minima of blocks."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tag (a hash of the text), text. Null and short texts included."""
    tag = F.xxhash64(F.col(text_col)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    return docs.select(F.col(id_col).cast("long").alias("id"), tag.alias("tag"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def combine(text: np.ndarray, s: np.ndarray, run: np.ndarray, h: np.ndarray, g: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Rows to keep, whether they stand for several, and (text, a, b) of covered ranges.

    Segments that repeat among the given ones are covered at once; the first of
    them stays to meet those of other batches. Ranges of a text are merged.
    """
    order = np.lexsort((g, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(order)))
    kept, several = order[at], sizes > 1
    rows = order[np.repeat(several, sizes)]
    rows = rows[np.lexsort((s[rows], text[rows]))]
    t, a, b = text[rows], s[rows].astype(np.int64), s[rows].astype(np.int64) + run[rows] - 1 + length
    if not len(rows):
        return kept, several, (t, a, b)
    # Running ends within each text: texts are set apart by a wide step.
    wide = np.int64(int(b.max()) + 1) * np.cumsum(np.append(0, (t[1:] != t[:-1]).astype(np.int64)))
    top = np.maximum.accumulate(b + wide)
    first = np.ones(len(rows), bool)
    first[1:] = a[1:] + wide[1:] > top[:-1]
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(rows)) - 1
    return kept, several, (t[begin], a[begin], (top - wide)[end])


def segments(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """h, g, id, tag, s, off, run, many, done, mate, salt: segments that no earlier one of their batch repeats.

    many: others of the batch are equal; mate: others of it have the anchor; salt:
    0 for the first of an anchor and batch. Rows with ``done`` are no segments
    but ranges found covered within a batch, under keys of their own.
    """
    names = ["h", "g", "id", "tag", "s", "off", "run", "many", "done", "mate", "salt"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(length, gram)
        for batch in batches:
            ids, tags = batch.column(0), batch.column(1)
            parts = list(scanner.segments(*_bytes_of(batch.column(2))))
            if not parts:
                continue
            text, s, off, run, h, g = (np.concatenate(c) for c in zip(*parts, strict=True))
            kept, several, (t, a, b) = combine(text, s, run, h, g, length)
            own, n, m = pa.array(np.concatenate([text[kept], t])), len(kept), len(t)
            # Kept rows are in the order of their anchors.
            later = np.zeros(n + 1, bool)
            later[1:-1] = h[kept][1:] == h[kept][:-1]
            mate, salt = later[1:] | later[:-1], np.where(later[:-1], g[kept] | np.uint64(1), np.uint64(0))
            alone = mix(a.astype(np.uint64) * np.uint64(_STEP) + mix(t.astype(np.uint64) + h[0]))
            cols = [
                np.concatenate([h[kept], alone]).view(np.int64), np.concatenate([g[kept], mix(alone)]).view(np.int64), ids.take(own), tags.take(own),
                np.concatenate([s[kept], a]).astype(np.int32), np.concatenate([off[kept], np.zeros(m, np.int64)]).astype(np.int16),
                np.concatenate([run[kept], b - a - length + 1]).astype(np.int32), np.concatenate([several, np.ones(m, bool)]), np.arange(n + m) >= n,
                np.concatenate([mate, np.zeros(m, bool)]), np.concatenate([salt, np.zeros(m, np.uint64)]).view(np.int64),
            ]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)

    schema = "h long, g long, id long, tag int, s int, off short, run int, many boolean, done boolean, mate boolean, salt long"
    return rows.where(F.octet_length("text") >= length).mapInArrow(scan, schema)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of an array of strings without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def repeated_windows(texts: list[bytes], offs: np.ndarray, runs: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int]]:
    """(text, start) of each window that occurs twice among segments of equal anchors.

    The segments' bytes are read as symbols of eight bytes from a phase that
    puts a symbol's start on the anchor; a separator smaller than any symbol
    stands between segments.
    """
    inner = length - SYMBOL  # bytes that a class of suffixes agrees in
    depth = inner // SYMBOL
    phase = offs % SYMBOL
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = (sizes - phase) // SYMBOL
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts) + bytes(length), np.uint8)
    heads = np.cumsum(counts + 1) - (counts + 1)
    owner = np.repeat(np.arange(len(texts)), counts + 1)
    step = np.arange(len(owner)) - heads[owner]
    byte = base[owner] + phase[owner] + step * SYMBOL
    raw = np.lib.stride_tricks.sliding_window_view(data, SYMBOL)[byte]
    word = np.ascontiguousarray(raw).view(">u8").reshape(-1).astype(np.uint64)
    real = step < counts[owner]
    symbol = np.zeros(len(owner), np.int64)
    symbol[real] = np.unique(word[real], return_inverse=True)[1] + 1
    order = suffix_array(symbol)
    order = order[(step + depth <= counts[owner])[order]]
    if not len(order):
        return
    same = np.ones(len(order) - 1, bool)
    for k in range(depth):
        left = np.flatnonzero(same)
        same[left] = symbol[order[left] + k] == symbol[order[left + 1] + k]
    kind = np.concatenate([[0], np.cumsum(~same)])
    # A window starts up to seven bytes before its class's suffix.
    seg, at = owner[order], (byte - base[owner])[order]
    back = np.arange(SYMBOL)
    start = at[:, None] - back
    ok = (start >= 0) & (start < runs[seg][:, None])
    row, d = np.nonzero(ok)
    here = base[seg[row]] + start[row, d]
    # The bytes of the window outside the class: d before it, the others after.
    place = np.arange(SYMBOL)
    rest = data[here[:, None] + np.where(place < d[:, None], place, place + inner)]
    rest = np.ascontiguousarray(rest).view(np.uint64).reshape(-1)
    key = kind[row] * SYMBOL + d
    by = np.lexsort((rest, key))
    twin = np.zeros(len(by) + 1, bool)
    twin[1:-1] = (key[by][1:] == key[by][:-1]) & (rest[by][1:] == rest[by][:-1])
    hit = by[twin[1:] | twin[:-1]]
    yield from zip(seg[row[hit]].tolist(), start[row[hit], d[hit]].tolist(), strict=True)


def _ranges(found: list[tuple[int, int]], length: int) -> Iterator[tuple[int, int, int]]:
    """(text, first, end) of the merged windows."""
    last = None
    for k, s in sorted(found):
        if last and last[0] == k and s <= last[2]:
            last = (k, last[1], s + length)
        else:
            if last:
                yield last
            last = (k, s, s + length)
    if last:
        yield last


def _search(groups: DataFrame, length: int) -> DataFrame:
    """id, tag, a, b: ranges covered by windows that segments of one key share."""
    rows = groups.repartition("h").sortWithinPartitions("h").select("h", "s", "off", "run", "need", "tag", "id", "seg")
    schema = pa.schema([("id", pa.int64()), ("tag", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])

    def find(cols: list) -> Iterator[pa.RecordBatch]:
        s, off, run, need, tag, ids, texts = cols
        found = list(repeated_windows(texts, off.astype(np.int64), run.astype(np.int64), length))
        got = [x for x in _ranges(found, length) if need[x[0]]]
        if got:
            k, a, b = (np.array(x) for x in zip(*got, strict=True))
            yield pa.record_batch([pa.array([ids[x] for x in k], pa.int64()), pa.array(tag[k]), pa.array((s[k] + a).astype(np.int32)), pa.array((s[k] + b).astype(np.int32))], schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)] + [batch.column(k).to_pylist() for k in (6, 7)]
            held = [np.concatenate([x, y]) if isinstance(y, np.ndarray) else x + y for x, y in zip(held, cols, strict=True)] if held else cols
            sizes = np.cumsum([len(t) for t in held[7]])
            while held and len(sizes) and sizes[-1] > ARRAY_SYMBOLS * SYMBOL:
                ends = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
                if not len(ends):
                    break
                fit = ends[sizes[ends - 1] <= ARRAY_SYMBOLS * SYMBOL]
                cut = int(fit[-1]) if len(fit) else int(ends[0])
                yield from find([c[:cut] for c in held[1:]])
                held = [c[cut:] for c in held]
                sizes = sizes[cut:] - sizes[cut - 1]
        if held and len(held[0]):
            yield from find(held[1:])

    return rows.mapInArrow(scan, "id long, tag int, a int, b int")


def _texts(segs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """The segments with seg, their bytes."""
    theirs = segs.withColumnsRenamed({"id": "__id", "tag": "__tag"})
    held = theirs.join(rows, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__tag") == F.col("tag")))
    return held.select("h", "m", "s", "off", "run", "need", "tag", "id", F.expr(f"substring(cast(text as binary), s + 1, run + {length - 1})").alias("seg"))


def _sharing(segs: DataFrame) -> DataFrame:
    """The segments (one of each kind) whose key has others, one of which is not covered yet, and m, their number."""
    keys = segs.groupBy("h").agg(F.count("*").alias("m"), F.max("need").alias("lacks")).where("m > 1 and lacks")
    return segs.join(keys.select(F.col("h").alias("__h"), "m"), F.col("h") == F.col("__h")).drop("__h")


def _halved(hot: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Segments under finer keys as from ``_sharing``, and the ranges of halves that are equal.

    lo and hi bound how far from its start a window of the key has its anchor;
    the bytes that all windows within these bounds reach belong to the key.
    """
    middle = F.expr("(lo + hi + 1) div 2").cast("int")
    both = F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), (middle - 1).alias("hi")))
    cut = hot.withColumn("half", F.explode(both)).withColumn("i", F.greatest(F.lit(0), F.col("off") - F.col("half.hi")))
    cut = cut.withColumn("n", F.least(F.col("run") - 1, F.col("off") - F.col("half.lo")) - F.col("i") + 1).where("n > 0")
    cut = cut.select(
        "h", "id", "tag", (F.col("s") + F.col("i")).alias("s"), (F.col("off") - F.col("i")).alias("off"), F.col("n").alias("run"), "need",
        F.col("half.lo").alias("lo"), F.col("half.hi").alias("hi"), F.expr(f"substring(seg, i + 1, n + {length - 1})").alias("seg"),
    )
    key = F.expr(f"substring(seg, off - lo + 1, lo + {length} - hi)")
    cut = cut.withColumn("h", F.xxhash64("h", "lo", key)).withColumn("g", F.xxhash64(F.lit("g"), "off", "seg"))
    cut = checkpoint(cut)
    rest = [c for c in cut.columns if c not in ("h", "g")]
    kinds = cut.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct(*rest)).alias("one"))
    segs = kinds.select("h", "g", *[(F.col("one.need") & (F.col("n") == 1)).alias(c) if c == "need" else F.col(f"one.{c}") for c in rest])
    # Equal halves may be very many: dealt over some tasks.
    ways = 32
    equal = kinds.where("n > 1").select(F.col("h").alias("__h"), F.col("g").alias("__g"), F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("__w"))
    way = F.pmod(F.xxhash64("id", "tag", "s"), F.lit(ways))
    equal = cut.where("need").join(equal, (F.col("h") == F.col("__h")) & (F.col("g") == F.col("__g")) & (way == F.col("__w")))
    return checkpoint(_sharing(segs)), _whole(equal, length)


def _whole(segs: DataFrame, length: int) -> DataFrame:
    return segs.select("id", "tag", F.col("s").alias("a"), (F.col("s") + F.col("run") + F.lit(length - 1)).alias("b"))


def covered(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST_IN_TASK) -> DataFrame:
    """id, tag, a, b: byte ranges of repeated windows, which may overlap.

    rows: as from ``keyed``.
    """
    near = segments(rows, length, gram).withColumn("met", F.count("*").over(Window.partitionBy("h", "salt")))
    near = near.where("met > 1 or mate or many")
    equal = Window.partitionBy("h", "g")
    near = near.withColumn("twice", (F.count("*").over(equal) > 1) | F.max("many").over(equal))
    near = near.withColumn("one", ~F.col("done") & (F.row_number().over(equal.orderBy("id", "tag", "s")) == 1))
    near = checkpoint(near.select("h", "g", "id", "tag", "s", F.col("off").cast("int"), "run", "twice", "one"))
    found = _whole(near.where("twice"), length)
    apart = _sharing(near.where("one").withColumn("need", ~F.col("twice")).drop("twice", "one"))
    few, many = apart.where(F.col("m") <= most), apart.where(F.col("m") > most)
    # Texts are dealt by id once, for these segments and for the removal alike.
    groups = _texts(few, rows, length)
    if not many.take(1):
        return found.unionByName(_search(groups, length))
    # What is halved has to be written first, so only texts that hold it are dealt again.
    rows, _ = parted(rows, F.xxhash64("id", "tag"), many.select(F.xxhash64("id", "tag").alias("key")))
    hot = checkpoint(_texts(many, rows, length)).withColumns({"lo": F.lit(0), "hi": F.lit(length - gram)})
    for _ in range((length - gram).bit_length()):
        finer, equal = _halved(hot, length, gram)
        found, groups = found.unionByName(equal), groups.unionByName(finer.where(F.col("m") <= most).select(*groups.columns))
        hot = finer.where(F.col("m") > most)
        if not hot.take(1):
            break
    else:
        # Keys that are whole windows hold one kind, unless hashes collide.
        groups = groups.unionByName(hot.select(*groups.columns))
    return found.unionByName(_search(groups, length))


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that touch or overlap, as one."""
    order = np.argsort(a, kind="stable")
    a, b = np.asarray(a)[order], np.maximum.accumulate(np.asarray(b)[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    at = np.flatnonzero(new)
    return a[at], b[np.append(at[1:], len(b)) - 1]


def cut(text: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    """What is left of a text without the (merged) ranges."""
    edges = [0, *np.stack([a, b], axis=1).reshape(-1).tolist(), len(text)]
    return b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST_IN_TASK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary; null where nothing is removed).

    A row of the input is a row of the result. Null texts are empty; texts under
    ``length`` bytes lose nothing. Texts that rows repeat, whatever the ids, are
    removed as a whole if they are long enough. Rows with a null id are told
    apart by their texts. A long text is cut into overlapping segments, so only
    its removed ranges come together in one row. No documents: no rows. Other
    columns are left, whatever their names.
    """
    rows = keyed(docs, id_col, text_col)
    ranges = covered(rows, length, gram, most).groupBy("id", "tag").agg(F.collect_list(F.struct("a", "b")).alias("__r"))
    ranges = ranges.select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), "__r")
    joined = rows.join(ranges, F.col("id").eqNullSafe(F.col("__id")) & (F.col("tag") == F.col("__tag")), "left")

    @F.pandas_udf("n_removed long, n_spans long, kept binary")
    def apply(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for text, a, b in zip(texts, starts, ends, strict=True):
            if text is None:
                out.append((0, 0, None))
                continue
            a, b = merged(a, b)
            out.append((int((b - a).sum()), len(a), cut(text, a, b)))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])

    body = F.col("text").cast("binary")
    done = joined.withColumn("__o", apply(F.when(F.col("__r").isNotNull(), body), F.col("__r.a"), F.col("__r.b")))
    return done.select(
        F.col("id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), "__o.n_removed", "__o.n_spans",
        F.sha2(F.coalesce(F.col("__o.kept"), body), 256).alias("kept_sha256"), F.col("__o.kept").alias("kept"),
    )
