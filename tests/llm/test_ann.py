import numpy as np

from tesserapy.llm import ann


def nearest(ids, x, q, k=10):
    far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    far[ids == q] = np.inf
    order = np.lexsort((ids, far))[:k]
    return [(int(ids[o]), far[o]) for o in order if np.isfinite(far[o])]


def test_recall_and_exact_scores(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    asked = [q for q in ids.tolist() if q % 100 == 0]
    assert set(got) == set(asked)
    hits = 0
    for q in asked:
        assert sorted(got[q]) == list(range(1, 11))
        found = [got[q][k] for k in range(1, 11)]
        assert found == sorted(found, key=lambda t: (t[1], t[0]))
        for v, s in found:
            assert abs(s - np.sqrt(((x[ids == v][0] - x[ids == q][0]) ** 2).sum())) < 1e-12
        hits += len({v for v, _ in found} & {v for v, _ in nearest(ids, x, q)})
    assert hits >= 0.9 * 10 * len(asked)


def test_index_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (500, 8), dtype=np.uint8)
    index = ann.Index(codes)
    for radius in (0, 5, 7, 8, 15, 20, 64):
        for q in codes[:20]:
            want = np.flatnonzero(np.bitwise_count(codes ^ q).sum(axis=1) <= radius)
            assert index.within(q, radius).tolist() == want.tolist()


def test_bad_vectors_ties_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (100, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (200, []), (None, [1.0, 2.0]), (8, [1.0, 2.0, 3.0]), (1, [0.0, 1.0])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, score int")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100), (0, 2, 1), (0, 3, 1), (0, 4, 2), (100, 1, 0), (100, 2, 1), (100, 3, 1), (100, 4, 2)]
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id = 1")).count() == 0


def test_other_rows_of_the_querys_id_are_candidates(spark):
    rows = [(100, [1.0, 1.0]), (100, [1.0, 1.0]), (100, [3.0, 3.0]), (5, [1.0, 1.0]), (6, [9.0, 9.0])]
    got = [(r["rank"], r["vec_id"], round(r["score"], 3)) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(1, 5, 0.0), (2, 100, 0.0), (3, 100, 2.828), (4, 6, 11.314)]


def test_recall_over_many_queries(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in ann.search(df, every=4).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(got) >= 100 and all(len(v) == 10 for v in got.values())
    hits = sum(len(v & {n for n, _ in nearest(ids, x, q)}) for q, v in got.items())
    print("recall", hits / (10 * len(got)))
    assert hits >= 0.95 * 10 * len(got)
