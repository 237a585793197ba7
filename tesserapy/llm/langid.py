"""Language ID: script ranges, per-word scores and a Viterbi pass over words.

A model holds log probabilities of letter trigrams and of whole words (hashed
into fixed tables) for each learned language, and the share of each script in
the language. A word's scripts narrow its candidates; the scores of the
candidates then go through Viterbi decoding, where changing the language between
two words costs a penalty. The result is spans of one language each.
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

FOLDS, HELD_FOLD = 4, 2
#: Documents of each language that the tables are counted over, about; all, if there are fewer.
TRAIN_ROWS = 3000
BUCKETS = 1 << 16
SWITCH = 12.0
SMOOTH = 0.5
#: Share of a language's letters in a script from which it is a candidate there.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"


@dataclass
class Words:
    """The words (runs of letters) of a chunk of texts."""

    doc: np.ndarray  # word -> text
    start: np.ndarray  # word -> first character in the chunk
    end: np.ndarray
    script: np.ndarray  # word -> script of its first letter
    whole: np.ndarray  # word -> bucket of the word
    trigram: np.ndarray  # letter -> bucket of the trigram around it
    first: np.ndarray  # word -> its first letter


def words_of(codes: np.ndarray, bounds: np.ndarray, buckets: int = BUCKETS) -> Words:
    lower = ta.lowered()[codes]
    flags = lower > 0
    start, end = ta.runs(flags, bounds)
    size = end - start
    first = np.cumsum(size) - size
    low = lower[flags].astype(np.uint64)
    left, right = np.zeros_like(low), np.zeros_like(low)
    left[1:], right[:-1] = low[:-1], low[1:]
    left[first] = 0
    right[first + size - 1] = 0
    tri = ta.mix((left << np.uint64(42)) | (low << np.uint64(21)) | right) & np.uint64(buckets - 1)
    whole = ta.run_hashes(lower, start, end) & np.uint64(buckets - 1)
    doc = np.searchsorted(bounds, start, "right") - 1
    return Words(doc, start, end, ta.scripts()[codes[start]], whole.astype(np.int64), tri.astype(np.int64), first)


@dataclass
class Model:
    langs: list[str]
    trigram: np.ndarray  # bucket x language, log probability
    whole: np.ndarray
    allowed: np.ndarray  # script x language
    switch: float = SWITCH

    def emissions(self, w: Words) -> np.ndarray:
        """Score of each word in each language; excluded candidates score far below."""
        if not len(w.doc):
            return np.zeros((0, len(self.langs)), np.float32)
        out = np.add.reduceat(self.trigram[w.trigram], w.first, axis=0) + self.whole[w.whole]
        out[~self.allowed[w.script]] -= np.float32(1e4)
        return out

    def decode(self, w: Words, scores: np.ndarray) -> np.ndarray:
        """The best path: a language for each word; texts advance in step."""
        n, k = scores.shape
        out = np.zeros(n, np.int64)
        if not n:
            return out
        _, off, size = np.unique(w.doc, return_index=True, return_counts=True)
        order = np.argsort(-size, kind="stable")
        off, size = off[order], size[order]
        active = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        back = np.zeros((n, k), np.int8 if k < 128 else np.int32)
        value = scores[off].copy()
        own, lane = np.arange(k), np.arange(len(off))
        for t in range(1, int(size[0])):
            a = active[t]
            now = value[:a]
            best = now.argmax(axis=1)
            jump = (now[lane[:a], best] - self.switch)[:, None]
            stay = now >= jump
            at = off[:a] + t
            back[at] = np.where(stay, own, best[:, None])
            value[:a] = np.where(stay, now, jump) + scores[at]
        state = value.argmax(axis=1)
        for t in range(int(size[0]) - 1, -1, -1):
            a = active[t]
            at = off[:a] + t
            out[at] = state[:a]
            state[:a] = back[at, state[:a]]
        return out

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of most letters, and its share of the letters."""
        langs, share = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, share
        for k, end, codes, bounds in ta.chunks(texts):
            if not len(codes):
                continue
            w = words_of(codes, bounds)
            path = self.decode(w, self.emissions(w))
            n, m = end - k, len(self.langs)
            letters = np.bincount(w.doc * m + path, w.end - w.start, n * m).reshape(n, m)
            total = letters.sum(axis=1)
            for d in np.flatnonzero(total):
                best = int(letters[d].argmax())
                langs[k + d], share[k + d] = self.langs[best], letters[d, best] / total[d]
        return langs, share

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first character, end, language) of the spans of a text."""
        out: list[tuple[int, int, str]] = []
        for _, _, codes, bounds in ta.chunks([text] if text and self.langs else []):
            w = words_of(codes, bounds)
            for a, b, lang in zip(w.start.tolist(), w.end.tolist(), self.decode(w, self.emissions(w)).tolist(), strict=True):
                if out and out[-1][2] == self.langs[lang]:
                    out[-1] = (out[-1][0], b, out[-1][2])
                else:
                    out.append((a, b, self.langs[lang]))
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, held: int = HELD_FOLD, most: int = TRAIN_ROWS, switch: float = SWITCH) -> Model:
    """Count trigrams and words by language, outside the held-out fold.

    Of each language about ``most`` documents are drawn by a hash of their id
    (all, if there are fewer); their counts are summed over tasks, and the tables
    of fixed size come to the driver. Rows with a null language or id teach
    nothing. Without any, the model knows no language and labels all ``und``.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).alias("__text"))
    rows = rows.where(fold_of(F.col("__id"), folds) != held).where("__lang is not null")
    sizes = {r["__lang"]: r["n"] for r in rows.groupBy("__lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0), bool))
    draw = F.lit(1.0)
    for name, n in sizes.items():
        if n > most:
            draw = F.when(F.col("__lang") == name, F.lit(most / n)).otherwise(draw)
    rows = rows.where(unit_hash(F.lit("lang"), F.col("__id")) < draw)
    place = {x: k for k, x in enumerate(langs)}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tri = np.zeros((len(langs), BUCKETS), np.int64)
        whole = np.zeros_like(tri)
        script = np.zeros((len(langs), len(ta.SCRIPTS) + 1), np.int64)
        for pdf in frames:
            lang = pdf["__lang"].map(place).to_numpy(np.int64)
            for k, end, codes, bounds in ta.chunks(pdf["__text"].tolist()):
                if not len(codes):
                    continue
                w = words_of(codes, bounds)
                own = lang[k:end][w.doc]
                letter = np.repeat(own, w.end - w.start)
                tri += np.bincount(letter * BUCKETS + w.trigram, minlength=tri.size).reshape(tri.shape)
                whole += np.bincount(own * BUCKETS + w.whole, minlength=tri.size).reshape(tri.shape)
                script += np.bincount(own * script.shape[1] + w.script, w.end - w.start, script.size).astype(np.int64).reshape(script.shape)
        for kind, table in enumerate((tri, whole, script)):
            lang, bucket = np.nonzero(table)
            yield pd.DataFrame({"kind": kind, "lang": lang, "bucket": bucket, "n": table[lang, bucket]})

    got = rows.mapInPandas(count, "kind int, lang int, bucket int, n long").groupBy("kind", "lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    tables = [np.zeros((BUCKETS, len(langs))), np.zeros((BUCKETS, len(langs))), np.zeros((len(ta.SCRIPTS) + 1, len(langs)))]
    for kind, table in enumerate(tables):
        own = got[got["kind"] == kind]
        table[own["bucket"], own["lang"]] = own["n"]
    logs = [np.log((t + SMOOTH) / (t.sum(axis=0) + SMOOTH * BUCKETS)).astype(np.float32) for t in tables[:2]]
    share = tables[2] / np.maximum(tables[2].sum(axis=0), 1)
    allowed = share >= SCRIPT_SHARE
    allowed[~allowed.any(axis=1)] = True
    return Model(langs, logs[0], logs[1], allowed, switch)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held: int = HELD_FOLD) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of letters) of every row.

    ``und`` with score 0 for null texts and texts without a letter. A null id is
    not held out. Repeated rows are labelled alike. A long text is a chunk
    of its own. No documents: no rows. Other columns are left, whatever
    their names.
    """
    key = F.col(id_col)
    rows = docs.select(key.alias("doc_id"), F.coalesce(fold_of(key, folds) == held, F.lit(False)).alias("held_out"), labeller(docs, model)(F.col(text_col)).alias("__l"))
    return rows.select("doc_id", "held_out", "__l.lang_pred", "__l.score")


def labeller(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        langs, share = shared.value.label(texts.tolist())
        return pd.DataFrame({"lang_pred": langs, "score": share})

    return label


def language_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, lang: the labelled spans, by characters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start:int,end:int,lang:string>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "lang": x} for a, b, x in shared.value.spans(t)] for t in texts])

    return docs.select(F.col(id_col).alias("doc_id"), F.inline(spans(F.col(text_col))))
