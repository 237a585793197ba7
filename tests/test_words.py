import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserapy.operators import frames, strata, words


def beam_of(spark, lists, degree, cap=None):
    rows = [([[{"d": d, "pos": p, "l": x} for p, (d, x) in enumerate(sorted(arr))] for arr in lists],)]
    df = spark.createDataFrame(rows, f"lists array<{words.LETTERS}>")
    out = df.select(words.beam(F.col("lists"), degree, cap).alias("w")).first()["w"]
    return [(r["d"], r["w"]) for r in out]


@pytest.mark.parametrize("seed", range(4))
def test_beam_finds_the_nearest_words(spark, seed):
    rng = np.random.default_rng(seed)
    lists = [[(float(rng.integers(0, 9)), k) for k in range(5)] for _ in range(3)]
    every = sorted((sum(d for d, _ in pick), [x for _, x in pick]) for pick in itertools.product(*lists))
    got = beam_of(spark, lists, 6)
    assert [d for d, _ in got] == [d for d, _ in every[:6]]
    assert got == sorted(got)


def test_beam_cap_keeps_equal_and_may_empty(spark):
    lists = [[(1.0, 0), (2.0, 1)], [(1.0, 0), (4.0, 1)]]
    assert beam_of(spark, lists, 5, cap=3.0) == [(2.0, [0, 0]), (3.0, [1, 0])]
    assert beam_of(spark, lists, 5, cap=1.5) == []


def test_heap_ties_keep_the_larger_word(spark):
    lists = [[(0.0, 5), (1.0, 0)], [(1.0, 1), (2.0, 2)]]
    rows = [[{"d": d, "l": x} for d, x in arr] for arr in lists]
    assert words.heap_words(rows, 2) == [(1.0, [5, 1]), (2.0, [5, 2])]
    assert beam_of(spark, lists, 2) == [(1.0, [5, 1]), (2.0, [0, 1])]
    assert words.heap_words(rows, 2, cap=1.0) == [(1.0, [5, 1])]
    assert words.heap_words(rows, 2, cap=0.5) == []


@pytest.mark.parametrize("seed", range(4))
def test_heap_finds_the_nearest_distances(seed):
    rng = np.random.default_rng(seed)
    lists = [sorted((float(rng.integers(0, 4)), k) for k in range(5)) for _ in range(3)]
    got = words.heap_words([[{"d": d, "l": x} for d, x in arr] for arr in lists], 6)
    every = {tuple(x for _, x in pick): sum(d for d, _ in pick) for pick in itertools.product(*lists)}
    assert [d for d, _ in got] == sorted(every.values())[:6]
    assert len({tuple(w) for _, w in got}) == 6 and all(every[tuple(w)] == d for d, w in got)


def test_heap_mode_of_plans(spark, plans):
    dist, letters = plans
    key = lambda r: (r["plan_uid"], r["place"], r["distance"], r["min_distance"])
    modes = [sorted(key(r) for r in words.enumerate_words(dist, letters, 3, dedupe=False, ties=t).collect()) for t in ("word", "heap")]
    assert modes[0] == modes[1]


@pytest.fixture()
def plans(spark):
    dist = spark.createDataFrame([(0, "a", "0.1", 0.5, [0, 1]), (1, "b", "0.1", 1.0, [0, 1]), (2, "a", "1.1", 0.5, [1, 1])], "plan_uid long, sample_tag string, plan_str string, freq double, plan_vector array<bigint>")
    letters = spark.createDataFrame([(0, [(0.0, 0, 0), (2.0, 1, 1)]), (1, [(0.0, 1, 1), (1.0, 0, 0)])], f"district_uid long, letters {words.LETTERS}")
    return dist, letters


def test_dedupe_drops_the_second_tag_unless_keyed_by_plan(spark, plans):
    dist, letters = plans
    got = words.enumerate_words(dist, letters, 3)
    assert {r["plan_uid"] for r in got.collect()} == {0, 2}
    assert {r["plan_uid"] for r in words.enumerate_words(dist, letters, 3, dedupe_key="plan_uid").collect()} == {0, 1, 2}
    uids = {r["word_str"]: r["word_uid"] for r in got.collect()}
    assert uids == {s: k for k, s in enumerate(sorted(uids))}


def test_partition_of_unity_and_flux_invariants(spark, plans):
    dist, letters = plans
    w = strata.pou_weights(words.enumerate_words(dist, letters, 3, dedupe_key="plan_uid"), dist, 1.0)
    per = {r["plan_uid"]: r["s"] for r in w.groupBy("plan_uid").agg(F.sum("phi_normalized").alias("s")).collect()}
    assert all(abs(s - 1) < 1e-12 for s in per.values())
    z = {r["word_uid"]: r["stationary"] for r in strata.stationary(w).collect()}
    assert abs(sum(z.values()) - 2) < 1e-12
    f = np.zeros((len(z), len(z)))
    for r in strata.flux(w).collect():
        f[r["word1"], r["word2"]] = r["value"]
    zz = np.array([z[k] for k in range(len(z))])
    held = zz > 0
    assert np.allclose(f[held].sum(axis=1), 1) and np.allclose(zz[held] @ f[held], zz)
    lap = np.zeros_like(f)
    for r in strata.laplacian(strata.flux(w)).collect():
        lap[r["word1"], r["word2"]] = r["value"]
    assert np.allclose(lap.sum(axis=1), 0)


def test_zero_temperature_gives_nan_that_sums_skip(spark):
    rows = [(0, 0, [0], 0.0, 0.0, "0", 0), (0, 1, [1], 2.0, 0.0, "1", 1)]
    w = spark.createDataFrame(rows, "plan_uid long, place int, word array<int>, distance double, min_distance double, word_str string, word_uid long")
    dist = spark.createDataFrame([(0, 1.0)], "plan_uid long, freq double")
    got = {r["word_uid"]: (r["phi"], r["phi_normalized"]) for r in strata.pou_weights(w, dist, 0.0).collect()}
    assert got[0] == (1.0, 1.0) and math.isnan(got[1][0]) and math.isnan(got[1][1])
    assert {r["word_uid"]: r["stationary"] for r in strata.stationary(strata.pou_weights(w, dist, 0.0)).collect()} == {0: 1.0, 1: 0.0}
    strict = {r["word_uid"]: r["phi"] for r in strata.pou_weights(w, dist, 0.0, strict=True).collect()}
    assert strict == {0: 1.0, 1: 0.0}
    warm = {r["word_uid"]: r["phi"] for r in strata.pou_weights(w, dist, 1.0).collect()}
    assert warm == {0: 1.0, 1: 0.0}
    pairs = {(r["word1"], r["word2"]) for r in strata.adjacency(strata.flux(strata.pou_weights(w, dist, 0.0))).collect()}
    assert pairs == {(0, 0)}


def test_spectra_have_the_trace(spark):
    flux = spark.createDataFrame([(0, 0, 0.75), (0, 1, 0.25), (1, 0, 0.5), (1, 1, 0.5)], "word1 long, word2 long, value double")
    got = strata.spectra(flux, strata.laplacian(flux), 2).collect()
    by = lambda k: sorted(r["re"] for r in got if r["kind"] == k)
    assert np.allclose(by("flux"), [0.25, 1.0]) and np.allclose(by("laplacian"), [0.0, 2.0])


def test_frames(spark):
    dens = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.0), (1, 1, 0.5), (2, 0, 0.0), (2, 1, 0.0)], "cluster_id int, precinct int, dens double")
    centers = spark.createDataFrame([(0, 3.5), (1, 0.5)], "precinct int, x double")
    word = frames.word_letters(spark, [2, 0, 1])
    rank = {r["letter"]: r["rank"] for r in frames.left_to_right(dens, word, centers).collect()}
    assert rank == {1: 0, 0: 1, 2: 2}
    vals = frames.letter_values(dens, frames.word_letters(spark, [2])).first()
    assert vals["vmax"] == vals["vmin"] + 1e-9
    alphas = {(r["letter"], r["precinct"]): r["alpha"] for r in frames.letter_alphas(dens, word).collect()}
    assert alphas == {(0, 0): 1.0, (0, 1): 0.5, (1, 0): 0.0, (1, 1): 1.0}
    colours = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0)], "place int, cr double, cg double, cb double")
    blend = {r["precinct"]: (r["r"], r["g"], r["b"], r["letters"], r["overlap"]) for r in frames.letter_blend(dens, word, colours).collect()}
    assert blend == {0: (0.0, 1.0, 0.0, 1, False), 1: (0.0, 0.5, 0.5, 2, True)}
    flags = [r["selected"] for r in frames.district_mask(spark, 3, [2]).orderBy("precinct").collect()]
    same = [r["selected"] for r in frames.district_mask(spark, 3, [False, False, True]).orderBy("precinct").collect()]
    assert flags == same == [False, False, True]
