import zlib

import numpy as np

from tesserapy.llm import langid
from tesserapy.llm import textarrays as ta


def trained(spark, rows):
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


ROWS = [(k, "the cat and the dog sat with that other thing " * 3, "en") for k in range(20)]
ROWS += [(k + 20, "der hund und die katze sind nicht mit einer ", "de") for k in range(20)]
ROWS += [(k + 40, "кошка и собака это не одно и то же ", "ru") for k in range(20)]


def slow_path(scores, penalty):
    n, k = scores.shape
    value, back = scores[0].copy(), []
    for t in range(1, n):
        best = int(value.argmax())
        stay = value >= value[best] - penalty
        back.append([j if stay[j] else best for j in range(k)])
        value = np.array([value[j] if stay[j] else value[best] - penalty for j in range(k)]) + scores[t]
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def test_decode_equals_a_loop_and_the_best_of_all_paths():
    from itertools import product

    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], None, None, None, 2.0)
    sizes = [1, 4, 0, 6, 2]
    doc = np.repeat(np.arange(5), sizes)
    scores = rng.normal(0, 2, (len(doc), 3)).astype(np.float32)
    w = langid.Words(doc, *[np.zeros(0)] * 6)
    got = model.decode(w, scores)
    for d in np.unique(doc):
        own = scores[doc == d].astype(float)
        assert got[doc == d].tolist() == slow_path(scores[doc == d], np.float32(2.0))
        total = lambda p: sum(own[t, x] for t, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert abs(total(got[doc == d].tolist()) - max(map(total, product(range(3), repeat=len(own))))) < 1e-4


def test_labels_spans_and_scripts(spark):
    model = trained(spark, ROWS)
    assert model.langs == ["de", "en", "ru"]
    langs, share = model.label(["the dog and the cat", "und der hund", "собака", None, "", "123 !?", "the cat sat with that thing собака кошка"])
    assert langs[:3] == ["en", "de", "ru"] and langs[3:6] == ["und"] * 3 and share[3:6].tolist() == [0, 0, 0] and langs[6] == "en"
    text = "the dog sat with the other thing собака и кошка не одно"
    spans = model.spans(text)
    assert [s[2] for s in spans] == ["en", "ru"] and text[spans[1][0] : spans[1][1]].startswith("собака")
    latin = [k for k, (n, _) in enumerate(ta.SCRIPTS) if n == "latin"][0] + 1
    assert model.allowed[latin].tolist() == [True, True, False]


def test_predict_rows_and_no_training_rows(spark):
    df = spark.createDataFrame([(2, "der hund", "x", 1), (2, "der hund", "x", 1), (None, None, None, None), (5, "w" * 300000, "q", 2)], "doc_id long, text string, lang_pred string, held_out int")
    got = langid.predict(df, trained(spark, ROWS)).collect()
    assert len(got) == 4
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert [r["lang_pred"] for r in langid.predict(df, trained(spark, ROWS[:0])).collect()] == ["und"] * 4
    assert langid.predict(df.limit(0), trained(spark, ROWS)).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) > 0
