"""Leading eigenvalues against a dense solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserapy.operators import spectrum, strata


def cells_of(spark, m):
    rows = [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m)) if m[i, j]]
    return spark.createDataFrame(rows, "i long, j long, value double").repartition(3)


def leading(spark, m, k, **options):
    return [r["value"] for r in spectrum.leading(cells_of(spark, m), k, **options).orderBy("idx").collect()]


@pytest.mark.parametrize(("n", "k"), [(1, 3), (3, 3), (40, 4)])
def test_leading_values_of_random_matrices(spark, n, k):
    rng = np.random.default_rng(n)
    m = rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.3) + np.eye(n)
    m = m + m.T
    want = np.sort(np.linalg.eigvalsh(m))[::-1][:k]
    assert np.allclose(leading(spark, m, k), want, atol=1e-8)


def test_values_that_occur_several_times(spark):
    blocks = np.kron(np.eye(4), np.ones((5, 5)) / 5) + 0.5 * np.diag([1.0] * 3 + [0] * 17)
    want = np.sort(np.linalg.eigvalsh(blocks))[::-1]
    assert np.allclose(leading(spark, blocks, 5), want[:5], atol=1e-8)
    assert np.allclose(leading(spark, np.eye(7) * 2, 3), [2, 2, 2])


def test_few_vectors_are_an_error_and_empty_cells_give_none(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(30, 30))
    with pytest.raises(RuntimeError):
        leading(spark, m + m.T, 2, most=4)
    assert spectrum.leading(spark.createDataFrame([], "i long, j long, value double"), 3).collect() == []


def test_ensemble_spectra_equal_a_dense_solver(spark):
    from tesserapy.plans.queries import Ensemble

    e = Ensemble(spark, "/root/testdata/sf0.1")
    rows = strata.flux(e.weighted).collect()
    n = 1 + max(r["word1"] for r in rows)
    flux = np.zeros((n, n))
    for r in rows:
        flux[r["word1"], r["word2"]] = r["value"]
    near = (flux > 0).astype(float)
    laplacian = np.diag(near.sum(axis=1)) - near
    got = {(r["kind"], r["idx"]): r["value"] for r in query(spark)}
    for kind, values in (("flux", np.sort(np.linalg.eigvals(flux).real)[::-1]), ("laplacian", np.sort(np.linalg.eigvalsh(laplacian))[::-1])):
        assert np.allclose([got[kind, k] for k in range(5)], values[:5], atol=2e-6)


def query(spark):
    from tesserapy.plans import registry

    return registry.queries()["spectra_leading"](spark, "/root/testdata/sf0.1").withColumn("idx", F.col("idx").cast("int")).collect()
