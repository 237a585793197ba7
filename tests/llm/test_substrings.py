import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserapy.llm import substrings
from tesserapy.llm.gsaca import suffix_array


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_equals_sorting(values):
    assert suffix_array(np.array(values, np.int64)).tolist() == sorted(range(len(values)), key=lambda k: values[k:])


@pytest.mark.parametrize("values", [[1] * 50, [1, 2] * 30, [2, 1] * 30, list(range(40)), list(range(40))[::-1], [1, 1, 2] * 20 + [1]])
def test_suffix_array_of_periodic_texts(values):
    assert suffix_array(np.array(values)).tolist() == sorted(range(len(values)), key=lambda k: values[k:])


def brute(texts, length):
    seen = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    docs = []
    for _ in range(40):
        parts = [prose(rng.randrange(0, 40)) if rng.random() < 0.5 else shared[rng.randrange(4)][rng.randrange(30) :] for _ in range(rng.randrange(0, 4))]
        docs.append(" ".join(parts))
    copy = list(docs[3] or prose(80))
    for _ in range(3):
        copy[rng.randrange(len(copy))] = "#"
    return [*docs, "".join(copy), docs[5], "ab" * 400, "a" * 500, "a" * 150, "", None, prose(50) + "x" * 260 + prose(9), shared[0] + shared[0]]


@pytest.mark.parametrize("most", [substrings.MOST_IN_TASK, 3])
def test_equals_brute_force(spark, most):
    texts = corpus(1)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, seg string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.dedup(df, most=most).collect()}
    assert [got[k] for k in range(len(texts))] == brute([(t or "").encode() for t in texts], 200)


@pytest.mark.parametrize("most", [1, 4, 50])
def test_many_segments_of_one_anchor(spark, most):
    """A passage in very many texts, with contexts of their own, of a few kinds, and shared on one side only."""
    rng = random.Random(7)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, kinds = some(190), [some(150) for _ in range(3)]
    texts = []
    for k in range(70):
        left = kinds[k % 3][k % 7 :] if k % 2 else some(150)
        right = kinds[k % 2][: 150 - k % 5] if k % 3 else some(150)
        texts.append(left + passage[: 190 - (k % 4) * (k % 9)] + right)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.dedup(df, most=most).collect()}
    assert [got[k] for k in range(len(texts))] == brute([t.encode() for t in texts], 200)


def test_repeated_rows_null_ids_and_no_rows(spark):
    body = "".join(random.Random(2).choice("abcdefgh") for _ in range(400))
    df = spark.createDataFrame([(1, body), (1, body), (None, body[:250] + "q" * 30), (None, "short"), (2, "z" + body[100:])], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in substrings.dedup(df).collect())
    assert got == [("1", 400, 400), ("1", 400, 400), ("2", 301, 300), ("None", 5, 0), ("None", 280, 250)]
    assert substrings.dedup(df.limit(0)).count() == 0


def test_long_texts_are_scanned_in_pieces():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 123, 30000).astype(np.uint8)
    small, whole = substrings.Scanner(piece=4096), substrings.Scanner()
    runs = lambda s: sum(int(x[3].sum()) for x in s.segments(data, np.array([0, len(data)])))
    assert runs(small) == runs(whole) == len(data) - 199


def test_very_long_text_with_clashing_columns(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    body = " ".join(word() for _ in range(60_000))
    shared = body[100_000:101_000]
    texts = [body, "short " + shared + " tail", body[:150] + " other", shared * 2]
    rows = [(k, t, k, "x", b"y") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, g string, kept binary").withColumnRenamed("g", "a.b")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.dedup(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute([t.encode() for t in texts], 200)
    assert got[0][1] >= 1000 and got[2][1] == 0
