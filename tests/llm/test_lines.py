import random
import time

from tesserapy.llm import lines


def brute(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        cut = text.split("\n")
        gone = set()
        for p in range(len(cut) - 2):
            w = tuple(cut[p : p + 3])
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out[doc_id] = (len(cut), len(gone), "\n".join(x for p, x in enumerate(cut) if p not in gone))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, "\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in lines.dedup_lines(df).collect()}
    assert got == brute(rows)


def test_edges(spark):
    long = "\n".join(f"line {k}" for k in range(30000))
    rows = [(1, None, "q", 1), (2, "", "q", 2), (3, "a\nb", "q", 3), (4, long, "q", 4), (5, "a\nb\nc", None, 5), (None, "a\nb\nc", "z", 6), (7, "x\ny\nz", "r", 7), (7, "x\ny\nz", "r", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos string, starts int")
    got = {(r["doc_id"], r["starts"]): (r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(df).collect()}
    assert got[1, 1] == (0, 0) and got[2, 2] == (1, 0) and got[3, 3] == (2, 0) and got[4, 4] == (30000, 0)
    # A null id comes first, and rows of one document agree.
    assert got[None, 6] == (3, 0) and got[5, 5] == (3, 3) and got[7, 7] in ((3, 0), (3, 3))
    assert lines.dedup_lines(df).count() == 8
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_long_text_with_removal_is_linear(spark):
    """A window cut from a text of very many lines, and one that loses every line but the first ones."""
    long = [f"line {k}" for k in range(60000)]
    rows = [(1, "\n".join(long[:3])), (2, "\n".join(["head", *long])), (3, "\n".join(["own", *long[100:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.time()
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in lines.dedup_lines(df).collect()}
    assert time.time() - start < 30
    assert got[2] == (60001, 3, "\n".join(["head", *long[3:]])) and got[3] == (59901, 59900, "own") and got[1][1] == 0


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 777, 5, "k", 1, 2), (2, "a\nb\nc", 778, 6, "l", 3, 4)], "doc_id long, text string, n_lines int, n_removed int, k1 string, starts int, `a.b` int")
    out = lines.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines_", "n_removed_"]
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "a\nb\nc", 777, 5, "k", 1, 2, 3, 0), (2, "", 778, 6, "l", 3, 4, 3, 3)]
    assert lines.dedup_lines(df, counts=False).columns == df.columns
