import re
import zlib

import numpy as np

from tesserapy.llm import quality


def test_statistics_of_plain_texts():
    text = "One two. TWO one\n\none, two 12\nOne two. TWO one"
    row = dict(zip(quality.STATISTICS, quality.statistics([text, None, "", text])[0].tolist(), strict=True))
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert abs(row["words"] - np.log1p(len(words))) < 1e-6 and abs(row["distinct_words"] - len(set(words)) / len(words)) < 1e-6
    assert abs(row["digits"] - 2 / len(text)) < 1e-6 and abs(row["top_word"] - 2 / len(words)) < 1e-6
    assert abs(row["lines"] - np.log1p(3)) < 1e-6 and abs(row["distinct_lines"] - 2 / 3) < 1e-6
    pairs = list(zip(words, words[1:], strict=False))
    assert abs(row["distinct_pairs"] - len(set(pairs)) / len(pairs)) < 1e-6
    x = quality.statistics([text, None, "", text])
    assert not x[1:3].any() and (x[0] == x[3]).all()


def test_chunks_do_not_change_statistics(monkeypatch):
    from tesserapy.llm import textarrays as ta

    texts = ["a b c " * 50, None, "Zz. " * 10, "x" * 500, "é ü\n" * 20]
    whole = quality.statistics(texts)
    real = ta.chunks
    monkeypatch.setattr(ta, "chunks", lambda t: real(t, 100))
    assert np.allclose(whole, quality.statistics(texts))


def test_trees_learn_and_walk_like_a_loop():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = quality.grow(x[:1500], y[:1500])
    p = model.score(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.95
    for row, margin in zip(x[1500:1520], model.margin(x[1500:1520]), strict=True):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        assert abs(total - margin) < 1e-9


def test_one_label_or_none_gives_the_share():
    assert abs(quality.grow(np.zeros((9, 2)), np.ones(9)).score(np.zeros((1, 2)))[0] - 0.95) < 1e-9
    assert quality.grow(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((2, 2))).tolist() == [0.5, 0.5]


def test_rows_and_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest one has under twenty held-out labels
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got) > 0
    odd = spark.createDataFrame([(1, None, 1), (1, None, 1), (None, "", 2), (10, "w " * 200000, 3)], "doc_id long, text string, score int")
    rows = quality.score(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"])
    assert quality.score(odd.limit(0), quality.train(docs, labels.limit(0))).count() == 0
