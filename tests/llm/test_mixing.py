import pytest
from pyspark.sql import functions as F

from tesserapy.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, copies int")


def level(sizes, weights, share, most):
    """Targets by repeated resharing."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / total >= most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = most * sizes[k]
            left -= out[k]
            open_.discard(k)
    return out


@pytest.mark.parametrize("sizes", [[10, 200, 30, 4, 55, 0], [1], [100, 1, 1], [7, 7, 7, 7]])
def test_targets_equal_repeated_resharing(spark, sizes):
    df = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = level(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))], 1.5, 2.0)
    assert all(abs(got[f"s{k}"] - w) < 1e-6 for k, w in enumerate(want))


def test_nulls_repeats_clashing_columns_and_reruns(spark):
    rows = [(1, "a b c", "x", 9, 9), (1, "a b c", "x", 9, 9), (None, None, None, 0, 0), (3, "", "y", 0, 0), (4, "\t one\x0btwo\n", None, 0, 0)]
    df = docs(spark, rows)
    got = mixing.mixed_sizes(df).collect()
    assert len(got) == 5 and sorted(r["size"] for r in got) == [0, 0, 2, 3, 3]
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_sizes(df).collect()))
    out = mixing.mix(df)
    assert out.columns == df.columns and out.groupBy("doc_id").count().where("count > 4").count() == 0


def test_taken_comes_near_the_target_and_equals_the_mix(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    per = mixing.mixed_sizes(df.select("*")).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"))
    assert all(abs(r["t"] - r["g"]) < 0.06 * r["g"] for r in per.collect())
    total = mixing.mixed_sizes(df).agg(F.sum("taken")).first()[0]
    assert mixing.mix(df).agg(F.sum(F.regexp_count("text", F.lit("w")))).first()[0] == total


def test_no_rows(spark):
    assert mixing.mixed_sizes(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0


def test_many_sources_are_joined_instead_of_broadcast(spark, monkeypatch):
    df = docs(spark, [(k, "a b", f"s{k % 4}", 0, 0) for k in range(40)])
    want = sorted(map(str, mixing.mixed_sizes(df).collect()))
    monkeypatch.setattr(mixing, "SMALL_ROWS", 2)
    assert sorted(map(str, mixing.mixed_sizes(df).collect())) == want


def test_clashing_columns_and_a_long_text(spark):
    rows = [(k, "w " * (200_000 if k == 0 else 3), "s", k, "a", 1, 2, 3, 4) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, goal int, __source string, size int, target int, times int, copy int")
    out = mixing.mix(df, most=2.0, share=2.0)
    assert out.columns == df.columns and out.count() == 40 and {(r["goal"], r["size"], r["copy"]) for r in out.collect()} == {(k, 1, 4) for k in range(20)}
    assert {r["doc_id"]: r["size"] for r in mixing.mixed_sizes(df).collect()} == {k: 200_000 if k == 0 else 3 for k in range(20)}
