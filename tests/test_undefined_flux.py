"""Words without weight, whose flux is 0 / 0."""

import datetime
import math

import duckdb
import numpy as np
import pytest

from tesserapy.operators import fixed_point, strata
from tesserapy.plans import registry

NAN = float("nan")
FLUX = "word1 long, word2 long, value double"


def values_of(rows, kind):
    return [(r["re"], r["im"]) for r in sorted(rows, key=lambda r: r["idx"]) if r["kind"] == kind]


def test_spectra_of_a_word_without_weight(spark):
    # Word 2 shares a plan with word 1, at no weight.
    flux = spark.createDataFrame([(0, 0, 0.75), (0, 1, 0.25), (1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.0), (2, 1, NAN), (2, 2, NAN)], FLUX)
    got = strata.spectra(flux, strata.laplacian(flux), 3).collect()
    values = values_of(got, "flux")
    assert np.allclose(values[:2], [(0.25, 0.0), (1.0, 0.0)])
    assert len(values) == 3 and all(math.isnan(v) for v in values[2])
    assert np.allclose(values_of(got, "laplacian"), [(0.0, 0.0), (0.0, 0.0), (2.0, 0.0)])


def test_undefined_block_holds_whole_cycles():
    m = np.zeros((6, 6))
    # 0 -> 1 -> 2 -> 1 with NaN at 2, 2 -> 3 -> 4 -> 3, and 5 alone.
    m[0, 1] = m[1, 2] = m[2, 1] = m[2, 3] = m[3, 4] = m[4, 3] = 1.0
    m[2, 2] = NAN
    assert strata.undefined_block(m).tolist() == [False, True, True, False, False, False]
    assert not strata.undefined_block(np.eye(3)).any()
    assert strata.undefined_block(np.zeros((0, 0))).tolist() == []


@pytest.fixture(scope="module")
def still(spark, tmp_path_factory):
    """A folder of tables whose periods are all alike: every district is a letter of its own, so the nearest words lie at distance 0 and others weigh nothing."""
    where = str(tmp_path_factory.mktemp("still"))
    day = datetime.datetime(1995, 1, 2)
    tables = {
        "nation": spark.createDataFrame([(k, f"n{k}", 0) for k in range(25)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": spark.createDataFrame([(100 * k + c, k) for k in range(25) for c in range(k + 1)], "c_custkey long, c_nationkey int"),
        "orders": spark.createDataFrame([(w, 0, day + datetime.timedelta(weeks=w)) for w in range(8)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{where}/{name}.parquet")
    return where


def sql_rows(where, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "orders"):
        con.execute(f"create view {t} as select * from read_parquet('{where}/{t}.parquet/*.parquet')")
    found = con.execute(registry.oracle_sql()[name])
    return [d[0] for d in found.description], found.fetchall()


def sorted_text(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def assert_equals_sql(spark, where, name):
    columns, want = sql_rows(where, name)
    got = registry.queries()[name](spark, where).select(*columns).collect()
    assert sorted_text(map(tuple, got)) == sorted_text(want)


def test_the_tables_have_words_with_and_without_weight(still):
    weights = [r[2] for r in sql_rows(still, "stationary")[1]]
    assert 0 in weights and max(weights) > 0


def test_spectra_query_returns_a_value_for_every_word(spark, still):
    weights = [r[2] for r in sql_rows(still, "stationary")[1]]
    got = registry.queries()["spectra"](spark, still).collect()
    values = values_of(got, "flux")
    assert len(values) == len(values_of(got, "laplacian")) == len(weights)
    assert sum(math.isnan(re) for re, _ in values) == weights.count(0)
    assert max(re for re, _ in values if not math.isnan(re)) == pytest.approx(1.0)


def test_spectra_traces_equal_sql(spark, still):
    assert_equals_sql(spark, still, "spectra_traces")


def test_leading_laplacian_values_are_those_of_spectra(spark, still):
    every = sorted((re for re, _ in values_of(registry.queries()["spectra"](spark, still).collect(), "laplacian")), reverse=True)
    rows = registry.queries()["spectra_leading"](spark, still).where("kind = 'laplacian'").orderBy("idx").collect()
    assert np.allclose([r["value"] for r in rows], every[:5], atol=2e-6)


def test_flux_fixed_point_equals_sql(spark, still):
    assert_equals_sql(spark, still, "flux_fixed_point")


def test_fixed_point_over_a_word_without_weight(spark):
    # Word 2 shares plans with 1 and with 3, at no weight; word 6 stands alone.
    cells = [(0, 0, 0.5), (0, 1, 0.5), (1, 0, 0.25), (1, 1, 0.75), (3, 3, 1.0), (1, 2, 0.0), (3, 2, 0.0), (2, 1, NAN), (2, 2, NAN), (2, 3, NAN), (6, 6, 1.0)]
    flux = spark.createDataFrame(cells, FLUX)
    weights = spark.createDataFrame([(0, 0.2), (1, 0.4), (2, 0.0), (3, 0.2), (6, 0.2)], "word_uid long, stationary double")
    got = {r["word_uid"]: (r["component"], round(r["z"], 9)) for r in fixed_point.fixed_point(flux, weights=weights).collect()}
    assert got == {0: (0, 0.25), 1: (0, 0.5), 2: (0, 0.0), 3: (0, 0.25), 6: (6, 1.0)}
    bare = {r["word_uid"]: r["component"] for r in fixed_point.fixed_point(flux).collect()}
    assert bare == {0: 0, 1: 0, 3: 3, 6: 6}


def test_word_adjacency_equals_sql(spark, still):
    assert_equals_sql(spark, still, "word_adjacency")


def test_undefined_cells_are_near_on_demand(spark):
    flux = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (1, 0, NAN), (1, 1, NAN), (2, 2, None)], FLUX)
    near = lambda **how: sorted(tuple(r) for r in strata.adjacency(flux, **how).collect())
    assert near() == [(0, 0)]
    assert near(undefined=True) == [(0, 0), (1, 0), (1, 1)]


def test_word_laplacian_equals_sql(spark, still):
    assert_equals_sql(spark, still, "word_laplacian")
