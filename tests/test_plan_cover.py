"""Matching distances, greedy covers and fixed points against plain loops."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserapy.operators import cover, fixed_point, matching


@pytest.mark.parametrize("n", [1, 2, 4, 6])
def test_matching_equals_all_permutations(spark, n):
    rng = np.random.default_rng(n)
    all_costs = [rng.integers(0, 50, (n, n)).tolist() for _ in range(12)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(all_costs)], "k int, costs array<array<bigint>>").repartition(2)
    got = {r["k"]: r["d"] for r in df.select("k", matching.cheapest_matching(F.col("costs"), n).alias("d")).collect()}
    assert got == {k: min(sum(c[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n))) for k, c in enumerate(all_costs)}


def test_matching_bounds(spark):
    assert spark.range(1).select(matching.cheapest_matching(F.lit(None), 0).alias("d")).first()["d"] == 0
    with pytest.raises(ValueError):
        matching.cheapest_matching(F.col("c"), matching.MOST + 1)


SETS = {0: [0, 1], 1: [2, 3], 2: [4], 3: [0, 2], 4: [1, 3, 4], 5: []}
WEIGHTS = [5, 1, 2, 7, 3]


def brute_plan_distance(x, y, n, cap):
    w = lambda s: sum(WEIGHTS[p] for p in s)
    pad = lambda v: [SETS[u] for u in v] + [None] * (n - len(v))
    d = lambda a, b: 0 if a is None and b is None else cap if a is None or b is None else min(cap, w(set(a) ^ set(b)))
    return min(sum(d(a, b) for a, b in zip(pad(x), order, strict=True)) for order in itertools.permutations(pad(y)))


def test_plan_distances_of_pairs(spark):
    districts = spark.createDataFrame(list(SETS.items()), "district_uid long, members array<int>")
    weights = spark.createDataFrame([(WEIGHTS, 9)], "weights array<bigint>, cap bigint")
    vectors = [[0, 1, 2], [3, 4, 5], [2, 0, 1], [5], [0, 4, 2]]
    key = lambda v: ".".join(map(str, v))
    plans = spark.createDataFrame([(key(v), v) for v in vectors], "plan_str string, plan_vector array<bigint>")
    pairs = [(key(a), key(b)) for a in vectors for b in vectors] + [(key(vectors[0]), key(vectors[1]))]
    asked = spark.createDataFrame(pairs, "one string, other string")
    spelt = matching.spelt_plans(plans, districts, weights)
    got = matching.plan_distances(asked, spelt, weights, 3).collect()
    assert len(got) == len(pairs)
    split = lambda t: [int(x) for x in t.split(".")]
    assert all(r["d"] == brute_plan_distance(split(r["one"]), split(r["other"]), 3, 9) for r in got)
    with pytest.raises(Exception, match="over 2 districts"):
        matching.plan_distances(asked, spelt, weights, 2).collect()


def test_next_plans_follow_steps_within_a_chain(spark):
    rows = [("a", 10, "x"), ("a", 3, "y"), ("b", 4, "z"), ("a", 7, "x"), (None, 1, "q"), (None, 2, "r"), ("b", 1, "x")]
    got = matching.next_plans(spark.createDataFrame(rows, "sample_tag string, step long, plan_str string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 3, 7, "y", "x"), ("a", 7, 10, "x", "x"), ("b", 1, 4, "x", "z"), (None, 1, 2, "q", "r")], key=str)


def brute_cover(edges):
    held, seen, picks, owner = {}, set(), [], {}
    for p, w in edges:
        held.setdefault(w, set()).add(p)
    while True:
        gain, w = max(((len(ps - seen), -w) for w, ps in held.items()), default=(0, 0))
        if not gain:
            return picks, owner
        picks.append((-w, len(picks), gain))
        owner |= dict.fromkeys(held[-w] - seen, -w)
        seen |= held[-w]


@pytest.mark.parametrize("seed", range(3))
def test_cover_equals_plain_greedy(spark, seed):
    rng = np.random.default_rng(seed)
    edges = {(int(p), int(w)) for p, w in zip(rng.integers(0, 60, 260), rng.zipf(1.3, 260) % 40, strict=True)}
    df = spark.createDataFrame([*edges, *list(edges)[:20], (None, 1), (2, None)], "plan_uid long, word_uid int").repartition(3)
    picks, owners = cover.greedy_cover(df)
    want, owner = brute_cover(edges)
    assert sorted((r["word_uid"], r["place"], r["gain"]) for r in picks.collect()) == sorted(want)
    assert {r["plan_uid"]: r["word_uid"] for r in owners.collect()} == owner
    assert {(r["word_uid"], r["place"]) for r in owners.collect()} == {w[:2] for w in want}


def test_cover_of_a_chain_of_ties_and_of_nothing(spark):
    # Words in a row, each sharing a plan with the next, all of equal gain: one pick a round.
    edges = [(p, w) for w in range(12) for p in (w, w + 1)]
    picks, _ = cover.greedy_cover(spark.createDataFrame(edges, "plan_uid long, word_uid int"))
    assert sorted((r["word_uid"], r["place"], r["gain"]) for r in picks.collect()) == sorted(brute_cover(edges)[0])
    picks, owners = cover.greedy_cover(spark.createDataFrame([], "plan_uid long, word_uid int"))
    assert picks.collect() == [] and owners.collect() == [] and owners.columns == ["plan_uid", "word_uid", "place"]


def test_near_words_by_distance(spark):
    rows = spark.createDataFrame([(1, 5, 2.0), (1, 6, 2.5), (1, 5, 1.0), (2, 5, 3.0)], "plan_uid long, word_uid int, distance double")
    assert [tuple(r) for r in cover.near_words(rows, 2.0).collect()] == [(1, 5)]


@pytest.mark.parametrize("seed", range(3))
def test_fixed_point_of_blocks(spark, seed):
    rng = np.random.default_rng(seed)
    n, blocks = 24, [list(range(0, 9)), list(range(9, 20)), [20], [21, 22, 23]]
    phi = np.zeros((60, n))
    for row in phi:
        own = blocks[rng.integers(len(blocks))]
        at = rng.choice(own, min(3, len(own)), replace=False)
        row[at] = rng.random(len(at))
    for k, own in enumerate(blocks):  # every word is held, and blocks hang together
        phi[k] = 0
        phi[k, own] = 1e-3 + rng.random(len(own)) * (0.01 if k == 1 else 1)
    phi /= phi.sum(axis=1, keepdims=True)
    z = phi.mean(axis=0)
    flux = (phi.T @ phi) / len(phi) / z[:, None]
    rows = [(i, j, float(flux[i, j])) for i in range(n) for j in range(n) if flux[i, j] > 0]
    cells = spark.createDataFrame([*rows, (0, 0, float("nan"))][: len(rows)], "word1 int, word2 int, value double")
    got = {r["word_uid"]: (r["component"], r["z"]) for r in fixed_point.fixed_point(cells).collect()}
    vector = np.zeros(n)
    for own in blocks:
        assert {got[w][0] for w in own} == {min(own)}
        vector[own] = [got[w][1] for w in own]
        assert np.allclose(vector[own], z[own] / z[own].sum(), atol=1e-8)
    assert np.abs(vector @ flux - vector).max() < 1e-9


def test_fixed_point_edge_cases(spark):
    schema = "word1 int, word2 int, value double"
    assert fixed_point.fixed_point(spark.createDataFrame([], schema)).collect() == []
    # A chain that only swaps two words never settles by plain steps.
    swap = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (5, 5, 1.0), (5, 6, float("nan"))], schema)
    assert sorted(tuple(r) for r in fixed_point.fixed_point(swap).collect()) == [(0, 0, 0.5), (1, 0, 0.5), (5, 5, 1.0)]
    uneven = spark.createDataFrame([(0, 1, 1.0), (1, 0, 0.5), (1, 2, 0.5), (2, 1, 1.0)], schema)
    assert [round(r["z"], 9) for r in sorted(fixed_point.fixed_point(uneven).collect())] == [0.25, 0.5, 0.25]
    with pytest.raises(RuntimeError):
        fixed_point.fixed_point(uneven, rounds=1)
