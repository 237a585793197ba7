"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Texts are encoded in Arrow batches, and DuckDB aligns a batch's tokens inside the
task: both tokenizers' tokens become interval tables on one axis of bytes, ASOF
joins find the first and the last token of the other side that a token meets, a
range join lists all between, and window sums over common ends number the groups.
Documents linked by a pair of ids are counted in each batch and the counts merged
in Spark; what a batch needs of the merged counts goes back to it by its number.

Neither tokenizer has a token that goes on over a space after a character that is
no blank (byte-level pre-tokenizing starts a token there, and no piece holds a
space mark behind another character). So texts are cut before such spaces, each
distinct part of a batch is aligned once, and a document is the row of its parts.
That bounds the memory of very long texts too: they are taken in runs of PART
characters. A part that no such space cuts is encoded whole.

Null and empty texts, and texts that a tokenizer does not give back byte for byte,
have no tokens: zeros and an empty digest. Repeated rows are documents of their
own. An empty table gives an empty one. Only the id and the text are read, so
columns of other names don't matter.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import shared_dir

#: Folder of the vocabulary files, and their names.
FOLDER, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text that are aligned at once.
PART = 2 << 20
#: An id pair is one number: the first id times this, plus the second id. Both vocabularies are smaller, and the number fits 31 bits.
WIDTH = 32_768
#: Place of the row that holds a batch's counts.
COUNTS = -1
#: Bits of a batch's number that count within a task.
WITHIN = 32

CUT = re.compile(r"(?<=\S) (?!\Z)")
#: In texts without such blanks every space may be a cut: a run of other blanks before it stays one token.
DOUBLE = re.compile(r"\A | (?:\s|\Z)")
#: Letters that all versions of Unicode class alike: parts of these alone may go to the faster encoder of the same merges.
SETTLED = re.compile(r"[\x00-\u024f\u2010-\u2027\u20ac]*")
#: Parts that a worker remembers between batches, at most; after that it keeps those met again.
REMEMBERED = 200_000
#: The byte-level pattern of the first tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HELD = "batch long, place int, {id}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<int>"
ALIGNED = "{id}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {groups} string"


class Tokenizers:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, folder: str, file_a: str, file_b: str):
        from sentencepiece import SentencePieceProcessor

        self.path = f"{folder}/{file_a}"
        self.b = SentencePieceProcessor(model_file=f"{folder}/{file_b}")
        with open(self.path, encoding="utf-8") as file:
            told = json.load(file)
        vocab, to_byte = told["model"]["vocab"], _byte_characters()
        self.bytes_a = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in told["added_tokens"])]))
        for token, k in vocab.items():
            self.bytes_a[k] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        if len(self.bytes_b) > WIDTH or len(self.bytes_a) * WIDTH > 1 << 31:
            raise ValueError("the vocabularies are too large for pairs of 31 bits")
        self.size_a, self.size_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        self.by_rank = self._ranks(told["model"])
        #: Each id as text with the sign that follows it: in a side, after the first side, after the second.
        self.spelt = np.array([f"{k}{sign}" for sign in ",|;" for k in range(len(self.bytes_a))], object)

    @cached_property
    def a(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def _ranks(self, model: dict):
        """An encoder by merge ranks, if ids of the file follow the order of its merges."""
        import tiktoken

        merges = [m.replace(" ", "", 1) if isinstance(m, str) else "".join(m) for m in model["merges"]]
        if any(model["vocab"][m] != 256 + k for k, m in enumerate(merges)):
            return None
        ranks = {self.bytes_a[k]: k for k in range(256 + len(merges))}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each part with a space before it; the second tokenizer adds that itself."""
        rank, settled = self.by_rank, SETTLED.fullmatch
        plain = [rank is not None and (p.isascii() or settled(p) is not None) for p in parts]
        hard = [f" {p}" for p, easy in zip(parts, plain, strict=True) if not easy]
        rest = iter(self.a.encode_batch(hard, add_special_tokens=False) if hard else [])
        return [rank(f" {p}") if easy else next(rest).ids for p, easy in zip(parts, plain, strict=True)], self.b.encode(parts, num_threads=1)


def _byte_characters() -> dict[str, int]:
    """Byte-level decoding: printable bytes stand for themselves, the others follow from 256 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def tokenizers(folder: str, file_a: str, file_b: str) -> Tokenizers:
    return Tokenizers(folder, file_a, file_b)


@lru_cache(maxsize=1)
def remembered(folder: str, file_a: str, file_b: str) -> Memory:
    """What this worker process remembers, for all of its tasks."""
    return Memory()


#: Tokens a and b (w: part, seq, id, s and e: bytes on one axis, e exclusive) to numbers of groups, and links.
GROUPS = """
create or replace temp table ends as select a.e from a join b on a.e = b.e;
create or replace temp table first_met as select a.w, a.id, a.e, b.seq f from a asof join b on a.s >= b.s;
create or replace temp table met as select x.w, x.id, x.f, b.seq l from first_met x asof join b on x.e > b.s;
create or replace temp table links as select x.w, x.id * {width} + b.id pair, count(*)::int n from (select w, id, unnest(range(f, l + 1))::int seq from met) x join b on b.seq = x.seq group by all;
"""
NUMBERS = "select coalesce(sum((ends.e is not null)::int) over (order by seq rows between unbounded preceding and 1 preceding), 0)::int g from {side} t left join ends on ends.e = t.e order by seq"
PAIRS = "select d.doc, l.pair, sum(d.n * l.n)::int times from docs d join held l on l.w = d.w group by all order by all"


@dataclass
class Parts:
    """Of a row of parts: n_a, n_b, n_groups, n_links and whether both tokenizers give it back; its groups; its links from offset to offset."""

    numbers: np.ndarray
    texts: np.ndarray
    offsets: np.ndarray
    pair: np.ndarray
    times: np.ndarray

    @staticmethod
    def none() -> Parts:
        empty = np.zeros(0, np.int32)
        return Parts(np.zeros((0, 5), np.int64), np.zeros(0, object), np.zeros(1, np.int64), empty, empty)

    def rows(self, at: np.ndarray) -> Parts:
        """The parts at these places."""
        size = np.diff(self.offsets)[at]
        offsets = np.append(0, np.cumsum(size))
        flat = np.repeat(self.offsets[at] - offsets[:-1], size) + np.arange(offsets[-1])
        return Parts(self.numbers[at], self.texts[at], offsets, self.pair[flat], self.times[flat])

    def and_then(self, more: Parts) -> Parts:
        joined = [np.concatenate(x) for x in ((self.numbers, more.numbers), (self.texts, more.texts), (self.offsets, more.offsets[1:] + self.offsets[-1]), (self.pair, more.pair), (self.times, more.times))]
        return Parts(*joined)


class Memory:
    """Parts that a worker has aligned, so that frequent ones are aligned once."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.place, self.parts = most, {}, Parts.none()

    def look(self, words: list[str], align: Callable[[list[str]], Parts]) -> Parts:
        """Of the given different words, what is remembered, and what align tells of the others."""
        at = np.fromiter((self.place.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            told = align([words[k] for k in new])
            at[new] = len(self.place) + np.arange(len(new))
            self.place.update((words[k], int(at[k])) for k in new)
            self.parts = self.parts.and_then(told)
        found = self.parts.rows(at)
        if len(self.place) > self.most:
            keep = np.setdiff1d(np.arange(len(words)), new)[: self.most // 2]
            self.place = {words[k]: i for i, k in enumerate(keep)}
            self.parts = found.rows(keep)
        return found


class Aligner:
    """Aligns runs of documents' parts in one DuckDB of a task."""

    def __init__(self, both: Tokenizers):
        self.both = both
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})

    def close(self) -> None:
        self.con.close()

    def _intervals(self, ids: tuple[list[list[int]], ...]) -> tuple[list[pa.Table], list[np.ndarray]]:
        """Both sides' tokens as intervals on one axis of bytes, and how many each part has."""
        tables, counts = [], []
        for side, sizes in zip(ids, (self.both.size_a, self.both.size_b), strict=True):
            count = np.fromiter(map(len, side), np.int32, len(side))
            flat = np.fromiter(chain.from_iterable(side), np.int32, int(count.sum()))
            end = np.cumsum(sizes[flat])
            columns = {"w": np.repeat(np.arange(len(side), dtype=np.int32), count), "seq": np.arange(len(flat), dtype=np.int32), "id": flat, "s": end - sizes[flat], "e": end}
            tables.append(pa.table(columns))
            counts.append(count)
        return tables, counts

    def _wrong(self, parts: list[str], ids: tuple[list[list[int]], ...], ends: list[np.ndarray]) -> list[int]:
        """Parts that a tokenizer doesn't give back; looked for one by one only if the whole is not right."""
        sides = tuple(zip((self.both.bytes_a, self.both.bytes_b), ids, strict=True))
        whole = f" {' '.join(parts)}".encode()
        if np.array_equal(*ends) and all(b"".join([of[i] for i in chain.from_iterable(side)]) == whole for of, side in sides):
            return []
        want = [f" {p}".encode() for p in parts]
        return [k for k, x in enumerate(want) if any(b"".join([of[i] for i in side[k]]) != x for of, side in sides)]

    def _spelt(self, ids: list[np.ndarray], groups: list[np.ndarray], count: list[np.ndarray]) -> np.ndarray:
        """Groups of each part as text: tokens in the order of group, side and place, each with what follows it."""
        n = [np.bincount(g, minlength=1) for g in groups]
        before = [np.append(0, np.cumsum(x)) for x in n]
        place = (np.arange(len(ids[0])) + before[1][groups[0]], np.arange(len(ids[1])) + before[0][groups[1] + 1])
        token, follows = np.zeros(len(ids[0]) + len(ids[1]), np.int64), np.zeros(len(ids[0]) + len(ids[1]), np.int64)
        for side in (0, 1):
            token[place[side]] = ids[side]
            follows[place[side][before[side][1:] - 1]] = side + 1
        words = self.both.spelt[follows * len(self.both.bytes_a) + token].tolist()
        at = [0, *np.cumsum(count[0] + count[1]).tolist()]
        return np.array(["".join(words[i:j])[:-1] for i, j in zip(at, at[1:], strict=False)], object)

    def parts(self, parts: list[str]) -> Parts:
        """What is known of each part."""
        both, n = self.both, len(parts)
        ids = both.encode(parts)
        tables, count = self._intervals(ids)
        ends = [np.append(0, t["e"].to_numpy())[np.cumsum(c)] for t, c in zip(tables, count, strict=True)]
        wrong = self._wrong(parts, ids, ends)
        if wrong:
            for k in wrong:
                ids[0][k], ids[1][k] = [], []
            tables, count = self._intervals(ids)
        for name, t in zip("ab", tables, strict=True):
            self.con.register(name, t)
        self.con.execute(GROUPS.format(width=WIDTH))
        group = [self.con.execute(NUMBERS.format(side=name)).fetchnumpy()["g"] for name in "ab"]
        got = self.con.execute("select w, pair, n from links order by w").fetchnumpy()
        offsets = np.searchsorted(got["w"], np.arange(n + 1))
        numbers = np.ones((n, 5), np.int64)
        numbers[:, 0], numbers[:, 1] = count
        last = np.append(-1, group[0])[np.cumsum(count[0])]
        numbers[:, 2] = np.diff(np.maximum.accumulate(np.append(-1, last)))
        numbers[:, 3] = np.diff(np.append(0, np.cumsum(got["n"]))[offsets])
        numbers[wrong, 4] = 0
        texts = self._spelt([t["id"].to_numpy() for t in tables], group, count) if len(group[0]) else np.full(n, "", object)
        return Parts(numbers, texts, offsets, got["pair"], got["n"])

    def pairs(self, parts: Parts, doc: np.ndarray, part: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc, pair, times of the links of documents' parts, by doc and pair."""
        links = {"w": np.repeat(np.arange(len(parts.texts), dtype=np.int32), np.diff(parts.offsets)), "pair": parts.pair, "n": parts.times}
        self.con.register("held", pa.table(links))
        self.con.register("docs", pa.table({"doc": doc, "w": part, "n": times}))
        got = self.con.execute(PAIRS).fetchnumpy()
        return got["doc"], got["pair"], got["times"]


class Doc:
    """What is known of a document whose runs are being aligned."""

    def __init__(self, key, keep_text: bool):
        self.key, self.digest, self.texts = key, hashlib.sha256(), [] if keep_text else None
        self.numbers, self.right, self.first = np.zeros(4, np.int64), True, True
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, numbers: np.ndarray, right: bool, text: str, pairs: np.ndarray, times: np.ndarray) -> None:
        self.right &= right
        if not self.right:
            return
        self.numbers += numbers
        self.digest.update(text.encode() if self.first else f";{text}".encode())
        if self.texts is not None:
            self.texts.append(text)
        self.first = False
        self.pairs.append(pairs)
        self.times.append(times)

    def row(self) -> tuple:
        """numbers, groups, pairs, times; of a document without tokens zeros and nothing."""
        if not self.right or self.first:
            none = np.zeros(0, np.int32)
            return np.zeros(4, np.int64), "", none, none
        pairs, times = (self.pairs[0], self.times[0]) if len(self.pairs) == 1 else _summed(np.concatenate(self.pairs), np.concatenate(self.times))
        return self.numbers, self.digest.hexdigest() if self.texts is None else ";".join(self.texts), pairs, times


def _summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(pairs, return_inverse=True)
    return found.astype(np.int32), np.bincount(at, times, len(found)).astype(np.int32)


def runs(text: str, most: int = PART) -> Iterator[str]:
    """A text in runs of about ``most`` characters, without the spaces between them."""
    place = 0
    while place <= len(text):
        end = CUT.search(text, place + most) if place + most < len(text) else None
        yield text[place : end.start()] if end else text[place:]
        if not end:
            return
        place = end.start() + 1


def parts_of(texts: list[str]) -> pa.ListArray:
    """The parts of each text, which single spaces join; none of an empty text."""
    out, plain = [], []

    def flush() -> None:
        if plain:
            out.append(pc.split_pattern(pa.array(plain, pa.string()), " ").cast(pa.list_(pa.string())))
            plain.clear()

    for t in texts:
        if t and not DOUBLE.search(t):
            plain.append(t)
        else:
            flush()
            out.append(pa.array([CUT.split(t) if t else []], pa.list_(pa.string())))
    flush()
    return pa.concat_arrays(out)


def _batches(frames: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[object, str, bool]]]:
    """Rows of a task as lists of (id, run of the text, whether it is the last), of about ``most`` characters each."""
    held, size = [], 0
    for frame in frames:
        for key, text in zip(frame.column(0), frame.column(1), strict=True):
            text = text.as_py() or ""
            place = 0
            for run in runs(text, most):
                place += len(run) + 1
                held.append((key, run, place > len(text)))
                size += len(run) + 64
                if size >= most:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def aligned_batches(frames: Iterator[pa.RecordBatch], schema: pa.Schema, both: Tokenizers, memory: Memory, most: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    """The rows of HELD for a task's documents."""
    task, number = TaskContext.get(), 0
    first = (task.partitionId() if task else 0) << WITHIN
    work, doc = Aligner(both), None
    try:
        for units in _batches(frames, most):
            lists = parts_of([run for _, run, _ in units])
            bounds, known = lists.offsets.to_numpy(), lists.values.dictionary_encode()
            flat = known.indices.to_numpy()
            words = [flat[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
            parts = memory.look(known.dictionary.to_pylist(), work.parts) if len(flat) else Parts.none()
            counted = [np.unique(w, return_counts=True) for w in words]
            at = np.repeat(np.arange(len(units), dtype=np.int32), [len(u) for u, _ in counted])
            part = np.concatenate([u for u, _ in counted]).astype(np.int32)
            unit, pairs, times = work.pairs(parts, at, part, np.concatenate([n for _, n in counted])) if len(part) else (np.zeros(0, np.int32),) * 3
            bounds = np.searchsorted(unit, np.arange(len(units) + 1))
            done = []
            for k, (key, _, last) in enumerate(units):
                doc = doc or Doc(key, keep_text)
                if len(words[k]):
                    own = parts.numbers[words[k]]
                    right = bool(own[:, 4].all())
                    doc.add(own[:, :4].sum(axis=0), right, ";".join(parts.texts[words[k]]) if right else "", pairs[bounds[k] : bounds[k + 1]], times[bounds[k] : bounds[k + 1]])
                if last:
                    done.append((doc.key, *doc.row()))
                    doc = None
            if done:
                yield _rows(done, first + number, schema)
                number += 1
    finally:
        work.close()


def _rows(done: list[tuple], batch: int, schema: pa.Schema) -> pa.RecordBatch:
    """A row for each document, and one with the documents that hold each pair."""
    pairs = [d[3] for d in done]
    found, docs = np.unique(np.concatenate(pairs), return_counts=True)
    pairs, times = [*pairs, found], [*[d[4] for d in done], docs]
    offsets = np.append(0, np.cumsum([len(p) for p in pairs])).astype(np.int32)
    lists = [pa.ListArray.from_arrays(offsets, np.concatenate(of).astype(np.int32)) for of in (pairs, times)]
    numbers = np.vstack([*[d[1] for d in done], np.zeros(4, np.int64)])
    keys = pa.array([*[d[0].as_py() for d in done], None], schema.field(2).type)
    columns = [np.full(len(pairs), batch), np.append(np.arange(len(done)), COUNTS).astype(np.int32), keys, *numbers.T, [*[d[2] for d in done], ""], *lists]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _meet(left: pa.Table, right: pa.Table, schema: pa.Schema) -> pa.Table:
    """Documents of a batch with what the corpus-wide counts of their pairs say."""
    pair = right["pair"].to_numpy()
    order = np.argsort(pair)
    pair, count, best = pair[order], right["count"].to_numpy()[order], right["best"].to_numpy(zero_copy_only=False)[order]
    pairs, times = (left[c].combine_chunks() for c in ("pairs", "times"))
    at = np.searchsorted(pair, pairs.flatten().to_numpy())
    n = times.flatten().to_numpy().astype(np.int64)
    sums = [np.append(0, np.cumsum(n * of[at])) if len(at) else np.zeros(1, np.int64) for of in (best.astype(np.int64), count)]
    bounds = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
    n_best, count_sum = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
    numbers = [left[c] for c in ("n_a", "n_b", "n_groups", "n_links")]
    columns = [left.column(2), *numbers, pa.array(n_best), pa.array(count_sum), left["groups"]]
    return pa.Table.from_arrays(columns, schema=schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B, part: int = PART, groups: str = "sha256") -> DataFrame:
    """Aligned documents and each batch's counts, as a table in the shared folder.

    groups: "text" keeps every document's groups as text, "sha256" their digest.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    held = spark.createDataFrame([], HELD.format(id=f"id {kind}")).schema
    arrow = to_arrow_schema(held)

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from aligned_batches(frames, arrow, tokenizers(folder, file_a, file_b), remembered(folder, file_a, file_b), part, groups == "text")

    path = f"{shared_dir(spark)}/aligned-{uuid.uuid4().hex}"
    rows.mapInArrow(work, held).write.parquet(path)
    return spark.read.schema(held).parquet(path)


def _counts(encoded: DataFrame) -> DataFrame:
    each = encoded.where(F.col("place") == COUNTS).select("batch", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    return each.select("batch", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("docs"))


def pair_counts(encoded: DataFrame) -> DataFrame:
    """id_a, id_b, count (documents that hold the pair linked), best (no other pair of id_a has more)."""
    whole = _counts(encoded).groupBy("pair").agg(F.sum("docs").alias("count"))
    whole = whole.withColumn("a", F.floor(F.col("pair") / WIDTH).cast("int"))
    most = whole.groupBy(F.col("a").alias("of")).agg(F.max("count").alias("most"))
    joined = whole.join(most, F.col("a") == F.col("of"))
    return joined.select(F.col("a").alias("id_a"), (F.col("pair") % WIDTH).alias("id_b"), "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B, part: int = PART, groups: str = "sha256") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every document."""
    encoded = encode(docs, id_col, text_col, folder, file_a, file_b, part, groups)
    pairs = pair_counts(encoded).select((F.col("id_a") * WIDTH + F.col("id_b")).alias("pair"), "count", "best")
    back = _counts(encoded).select("batch", "pair").join(pairs, "pair").select(F.col("batch").alias("of"), "pair", "count", "best")
    rows = encoded.where(F.col("place") != COUNTS)
    kind = encoded.schema["id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], ALIGNED.format(id=f"id {kind}", groups="groups")).schema
    arrow = to_arrow_schema(out)
    return rows.groupBy("batch").cogroup(back.groupBy("of")).applyInArrow(lambda left, right: _meet(left, right, arrow), out)


def aligned(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    found = align(docs, **options)
    return found.withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})
