import math

from pyspark.sql import functions as F

from tesserapy.functions import codecs, numbers
from tesserapy.functions.keys import numbered


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_vec_to_str_sorts_and_empty_set_is_empty_string(spark):
    vec = F.array(F.lit(10), F.lit(2), F.lit(1))
    row = one(spark, codecs.vec_to_str(vec), codecs.vec_to_str(F.array().cast("array<int>")))
    assert tuple(row) == ("1.2.10", "")


def test_str_to_vec_keeps_order_and_reads_empty(spark):
    row = one(spark, codecs.str_to_vec(F.lit("3.1.2")), codecs.str_to_vec(F.lit("")))
    assert tuple(row) == ([3, 1, 2], [])


def test_indicator_and_members(spark):
    row = one(spark, codecs.indicator(F.array(F.lit(0), F.lit(3)), F.lit(4)), codecs.members_of(F.array(*[F.lit(x) for x in (1, -1, 0, 1)]), F.lit(1)))
    assert tuple(row) == ([1, 0, 0, 1], [0, 3])


def test_distances_cap_and_dense_form(spark):
    a, b = F.array(F.lit(0), F.lit(1)), F.array(F.lit(1), F.lit(2))
    w = F.array(*[F.lit(x).cast("bigint") for x in (5, 7, 11)])
    dense = [F.array(*[F.lit(x) for x in v]) for v in ((1, 1, 0), (0, 1, 1))]
    row = one(spark, codecs.sparse_l1(a, b, w, F.lit(100)), codecs.sparse_l1(a, b, w, F.lit(9)), codecs.dense_l1(*dense, w), codecs.dense_l1(*dense, w, 9), codecs.dense_l1(*dense, w, None))
    assert tuple(row) == (16, 9, 16.0, 9.0, 16.0)


def test_division_and_comparison_follow_floating_point(spark):
    zero, x, nan = F.lit(0.0), F.lit(2.0), F.lit(float("nan"))
    row = one(spark, numbers.ratio(x, zero), numbers.ratio(-x, zero), numbers.ratio(zero, zero), numbers.positive(nan), numbers.positive(x))
    assert row[0] == math.inf and row[1] == -math.inf and math.isnan(row[2]) and row[3] is False and row[4] is True


def test_numbered_is_dense_over_buckets(spark):
    df = spark.createDataFrame([(x,) for x in ("b2", "a1", "c", "a10", "b1")], "s string")
    got = {r["s"]: r["n"] for r in numbered(df, [F.col("s")], "n").collect()}
    assert got == {s: k for k, s in enumerate(sorted(got))}
