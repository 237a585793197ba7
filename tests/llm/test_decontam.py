import random

import numpy as np

from tesserapy.llm import decontam


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
        row = new
    return row[-1]


def test_lcs_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 20))] for _ in range(2))
        assert decontam.lcs(a, b) == slow_lcs(a, b)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def test_copies_paraphrases_and_clean_texts(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    items = [prose(rng, n, words) for n in (12, 20, 30, 45, 60)]
    docs, truth = [], {}
    for k in range(120):
        text = prose(rng, rng.randrange(30, 300), words)
        if k % 10 < 5:
            item = items[k % 5]
            if k % 20 >= 10:
                item = item.upper().replace(" ", ",\n")
            text = f"{prose(rng, rng.randrange(0, 90), words)} {item} {text}"
            truth[k] = k % 5
        docs.append((k, text, "x"))
    # A paraphrase: every third word replaced, the answer kept.
    w = items[4].split()
    docs.append((500, prose(rng, 50, words) + " " + " ".join(x if k % 3 or k >= len(w) - 6 else "zzz" for k, x in enumerate(w)), "x"))
    truth[500] = 4
    # The same without the answer is not held to be the item.
    docs.append((501, " ".join(x if k % 3 and k < len(w) - 6 else "zzz" for k, x in enumerate(w)), "x"))
    docs += [(502, None, None), (503, "", None), (None, items[0], None), (504, " ".join(words * 20), None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, similarity string")
    bench = spark.createDataFrame([*enumerate(items), (9, None), (None, "a b c d e f g h i"), (10, "?!")], "item_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["kind"]) for r in decontam.contaminated(df, bench).collect()}
    assert {k: v[0] for k, v in got.items()} == {**truth, None: 0}
    assert got[500][1] == "paraphrase" and got[0][1] == "copy"
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and kept.count() == len(docs) - len(got)
    assert decontam.clean(df, bench.limit(0)).count() == len(docs) and decontam.contaminated(df.limit(0), bench).count() == 0


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("klmnopq") for _ in range(6)) for _ in range(500)]
    items = [prose(rng, 20, words) for _ in range(6)]
    df = spark.createDataFrame([(k, prose(rng, 40, words) + " " + items[k] + " " + items[(k + 1) % 6]) for k in range(6)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    one = sorted(map(tuple, decontam.contaminated(df, bench).collect()))
    monkeypatch.setattr(decontam, "ITEMS", 2)
    assert sorted(map(tuple, decontam.contaminated(df, bench).collect())) == one and all(r[4] == 2 for r in one)


def test_basis_holds_most_of_the_passages(spark):
    """Fewer dimensions than passages, and what is common to passages is kept."""
    texts = [f"w{k} x{k} y{k} z{k} common shared often seen" for k in range(10)]
    idf = np.ones(decontam.BUCKETS, np.float32)
    basis = decontam.latent_basis(spark.createDataFrame([(t,) for t in texts], "text string"), idf)
    assert basis.table.shape[1] == 7
    p = decontam.prepare([(k, t + " one two") for k, t in enumerate(texts)], basis, idf)
    assert len(p.ids) == 10 and (p.own > 0.55).all()


def test_words_have_digits_and_single_characters_of_scripts_without_blanks():
    def words(text):
        return len(decontam.words_by_text([text])[0])

    assert words("What is 12 plus 35-7?") == 6 and words("東京の塔") == 4 and words("\u0939\u093f\u0928\u094d\u0926\u0940 ab") == 2 and words("?! -- ...") == 0 and words("") == 0
    a, b = decontam.words_by_text(["add 12 and 35 to get 47 in all", "add 13 and 36 to get 49 in all"])
    assert decontam.lcs(a, b) == 6


def test_short_items_are_found_word_for_word(spark):
    items = ["who wrote the old red book", "what is 12 plus 35 minus 7", "3 1 4 1 5 9 2", "forty two", "東京塔の高さ"]
    docs = [
        (1, "Filler here. Who wrote the old, red book? And more."), (2, "so what is 12 plus 35 minus 7 then"), (3, "what is 12 plus 36 minus 7"), (4, "digits 3 1 4 1 5 9 2 6"),
        (5, "it was forty two in all"), (6, "Answer:\nForty two.\nmore"), (7, "who wrote the old blue red book"), (8, "x\n東京塔の高さは"), (9, None), (10, "forty"), (11, "東京塔"),
    ]
    got = {r["doc_id"]: (r["item_id"], r["similarity"], r["kind"]) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == {1: (0, 1.0, "copy"), 2: (1, 1.0, "copy"), 4: (2, 1.0, "copy"), 6: (3, 1.0, "copy"), 8: (4, 1.0, "copy")}


def brute(items, docs):
    """(doc_id, item_id) of every item that the check accepts at any place of a text, and those of short items."""
    words = decontam.words_by_text([t for _, t in items])
    out = set()
    for (d, _), text in zip(docs, decontam.words_by_text([t for _, t in docs]), strict=True):
        own, seen = np.array(text, np.uint64), set(text)
        for (i, _), item in zip(items, words, strict=True):
            if sum(x in seen for x in item) >= decontam.PARAPHRASE * len(item) and any(decontam.verdict(item, own, at) for at in range(-len(item), len(own))):
                out.add((d, i))
    return out


def test_query_against_brute_force_with_planted_paraphrases(spark, sf_dir):
    """Short and long items with 0 to half of their words replaced, by words of the corpus or by unknown ones, the answer kept."""
    rng = random.Random(11)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    plain = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000").collect()]
    pool = [w for _, t in plain for w in t.split()]
    docs, planted = list(plain), {}
    for k in range(240):
        i, text = rng.choice(items)
        w, share = text.split(), (0, 0.2, 0.3, 0.45, 0.5)[k % 5]
        for at in rng.sample(range(len(w) - 6), min(len(w) - 6, round(share * len(w)))):
            w[at] = rng.choice(pool) if k % 2 else f"zq{rng.randrange(10**6)}"
        body = rng.choice(plain)[1].split()
        at = rng.randrange(len(body) + 1)
        docs.append((10**6 + k, " ".join(body[:at] + w + body[at:])))
        planted[10**6 + k] = (i, share)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {d for d, _ in brute(items, docs)}
    got = {r["doc_id"]: r["item_id"] for r in decontam.contaminated(df, bench).collect()}
    assert set(got) <= want
    for share in (0, 0.2, 0.3, 0.45, 0.5):
        true = {d for d, (_, s) in planted.items() if s == share and d in want}
        print(share, len(true), len(true & set(got)) / len(true))
        assert len(true & set(got)) >= (0.95 if share < 0.4 else 0.9) * len(true)
    true = want - set(planted)
    assert len(true & set(got)) >= 0.95 * len(true) and true


def test_long_texts_empty_tables_and_clashing_columns(spark):
    item = " ".join(f"q{k}" for k in range(30))
    long = " ".join(f"w{k}" for k in range(200000))
    df = spark.createDataFrame([(1, long + " " + item, 5, "a"), (2, long, 6, "b"), (2, long, 6, "b"), (None, None, None, None)], "doc_id long, text string, hit int, item_id string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    marked = decontam.mark(df, bench)
    assert marked.columns == [*df.columns, "hit_"] and [r["doc_id"] for r in marked.where("hit_ is not null").collect()] == [1]
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and sorted((r["hit"] or 0) for r in kept.collect()) == [0, 6, 6]
    assert decontam.clean(df.limit(0), bench).count() == 0 and decontam.mark(df, bench.limit(0)).where("hit_ is null").count() == 4
