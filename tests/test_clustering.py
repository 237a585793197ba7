import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserapy.operators import cluster, distance
from tesserapy.operators.hcc import agglomerate, linkage


def brute(d):
    """The definition itself: sets of members, and counts over revealed edges."""
    n = len(d)
    home, groups, revealed, out = list(range(n)), {v: {v} for v in range(n)}, set(), []
    for dist, i, j in sorted((d[i][j], i, j) for i in range(n) for j in range(i)):
        revealed |= {(i, j), (j, i)}
        k, m = home[i], home[j]
        if k == m:
            continue
        half = lambda a, b: all(2 * sum((x, y) in revealed for y in groups[b]) >= len(groups[b]) for x in groups[a])
        if half(k, m) and half(m, k):
            r = n + len(out)
            groups[r] = groups.pop(k) | groups.pop(m)
            for v in groups[r]:
                home[v] = r
            out.append((len(out), k, m, dist, len(groups[r])))
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 9), st.integers(1, 6), st.integers(0, 10**6))
def test_agglomerate_equals_the_definition(n, top, seed):
    rng = np.random.default_rng(seed)
    d = rng.integers(1, top + 1, (n, n))
    d = np.tril(d, -1) + np.tril(d, -1).T
    edges = [(i, j, x) for x, i, j in sorted((int(d[i][j]), i, j) for i in range(n) for j in range(i))]
    got = list(agglomerate(n, edges))
    assert got == brute(d.tolist()) and len(got) == n - 1
    assert [g[3] for g in got] == sorted(g[3] for g in got)


def test_linkage_and_cuts(spark):
    d = [(1, 0, 1), (2, 0, 5), (2, 1, 6), (3, 0, 7), (3, 1, 8), (3, 2, 2)]
    df = spark.createDataFrame(d, "i int, j int, d bigint")
    rows = linkage(df, 4)
    assert [(r["a"], r["b"], r["distance"], r["size"]) for r in rows.orderBy("step").collect()][:2] == [(1, 0, 1, 2), (3, 2, 2, 2)]
    cut = lambda k: {r["district_uid"]: r["cluster_id"] for r in cluster.cut_linkage(rows, k, 4).collect()}
    assert cut(2) == {0: 0, 1: 0, 2: 1, 3: 1}
    assert cut(3) == {2: 0, 3: 1, 0: 2, 1: 2}
    assert set(cut(1).values()) == {0} and set(cut(4).values()) == {0} and set(cut(9).values()) == {0}
    assert linkage(df.limit(0), 1).count() == 0


@pytest.fixture()
def small(spark):
    districts = spark.createDataFrame([(0, [0, 1]), (1, [0]), (2, [2, 3]), (3, [])], "district_uid bigint, members array<int>")
    weights = spark.createDataFrame([([1, 2, 3, 4], 10, 6)], "weights array<bigint>, total bigint, cap bigint")
    return districts, weights


def test_distances_are_capped_and_a_metric_without_cap(spark, small):
    districts, weights = small
    got = {(r["i"], r["j"]): r["d"] for r in distance.pair_distances(districts, weights).collect()}
    assert got == {(1, 0): 2, (2, 0): 6, (2, 1): 6, (3, 0): 3, (3, 1): 1, (3, 2): 6}
    dense = {(r["i"], r["j"]): r["d"] for r in distance.dense_pair_distances(districts, weights, capped=False).collect()}
    assert dense[(2, 0)] == 10.0 and all(dense[a, c] <= dense.get((a, b), dense.get((b, a))) + dense.get((b, c), dense.get((c, b))) for a, c in dense for b in range(4) if b not in (a, c))


def test_empty_cluster_has_weight_zero_and_can_attract(spark, small):
    districts, weights = small
    now = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 0)], "district_uid bigint, cluster_id int")
    letters = cluster.centroids(districts, now, weights, 3)
    got = {r["cluster_id"]: (r["members"], r["weight"]) for r in letters.collect()}
    assert got == {0: ([0], 1), 1: ([2, 3], 7), 2: ([], 0)}
    near = {r["district_uid"]: r["cluster_id"] for r in cluster.assign_nearest(districts, letters, weights, now).collect()}
    assert near == {0: 0, 1: 0, 2: 1, 3: 2}
    dens = {(r["cluster_id"], r["precinct"]): r["dens"] for r in cluster.densities(districts, now, 3, 4).collect()}
    assert len(dens) == 12 and dens[0, 0] == 2 / 3 and dens[2, 0] == 0.0


def test_ties_prefer_the_current_cluster(spark, small):
    districts, weights = small
    letters = spark.createDataFrame([(0, [0], 1), (1, [0], 1)], "cluster_id int, members array<int>, weight bigint")
    now = spark.createDataFrame([(u, 1 if u == 1 else 5) for u in range(4)], "district_uid bigint, cluster_id int")
    near = {r["district_uid"]: r["cluster_id"] for r in cluster.assign_nearest(districts, letters, weights, now).collect()}
    assert near[1] == 1 and near[0] == 0


def test_quantile_edges_match_pandas(spark):
    pd = pytest.importorskip("pandas")
    values = [3, 5, 5, 9, 14, 20]
    df = spark.createDataFrame([(v,) for v in values], "d bigint")
    got = distance.quantile_edges(df, 16, 5).first()["edges"]
    kept = [v for v in values if v < 16] + [-1, 17]
    _, edges = pd.qcut(kept, q=5, retbins=True, duplicates="drop")
    assert got == np.unique(edges.astype(np.int32)).tolist()


def cuts_wcss(members, weights, cap, merges, n):
    """WCSS of every number of clusters, each cut on its own."""
    w = lambda s: sum(weights[p] for p in s)
    out, groups = {}, {v: [v] for v in range(n)}
    for t in range(n):
        if t:
            a, b = merges[t - 1]
            groups[n + t - 1] = groups.pop(a) + groups.pop(b)
        total = 0
        for own in groups.values():
            count = {}
            for v in own:
                for p in members[v]:
                    count[p] = count.get(p, 0) + 1
            centre = {p for p, c in count.items() if 2 * c >= len(own)}
            total += sum(min(cap, w(set(members[v]) ^ centre)) for v in own)
        out[n - t] = total
    return out


@pytest.mark.parametrize(("n", "chain"), [(2, False), (9, False), (14, True), (23, False)])
def test_elbow_curve_equals_every_cut(spark, monkeypatch, n, chain):
    rng = np.random.default_rng(n)
    members = [sorted(map(int, rng.choice(8, rng.integers(0, 6), replace=False))) for _ in range(n)]
    weights = [int(x) for x in rng.integers(1, 9, 8)]
    alive, merges = list(range(n)), []
    for t in range(n - 1):
        a, b = (alive.pop(), alive.pop(0)) if chain else (alive.pop(int(rng.integers(len(alive)))), alive.pop(int(rng.integers(len(alive) - 1))) if len(alive) > 1 else alive.pop())
        merges.append((a, b))
        alive.append(n + t)
    districts = spark.createDataFrame(list(enumerate(members)), "district_uid bigint, members array<int>")
    one = spark.createDataFrame([(weights, 12)], "weights array<bigint>, cap bigint")
    rows = spark.createDataFrame([(t, a, b, 0, 0) for t, (a, b) in enumerate(merges)], "step int, a bigint, b bigint, distance bigint, size bigint")
    monkeypatch.setattr(cluster, "STEPS", 4)
    curve = cluster.elbow_curve(districts, rows, one, n)
    want = cuts_wcss(members, weights, 12, merges, n)
    assert {r["k"]: r["wcss"] for r in curve.collect()} == want
    for k in (1, n // 2, n - 1):
        if 0 < k < n:
            cut = cluster.cut_linkage(rows, k, n)
            assert cluster.wcss(districts, cut, cluster.centroids(districts, cut, one, k), one).first()["wcss"] == want[k]


def test_knee_of_a_bent_curve(spark):
    rows = [(1, 100), (2, 60), (3, 20), (4, 18), (5, 17), (6, 16)]
    assert tuple(cluster.knee(spark.createDataFrame(rows, "k bigint, wcss bigint")).first()) == (3, 20)
    assert tuple(cluster.knee(spark.createDataFrame([(1, 0)], "k bigint, wcss bigint")).first()) == (1, 0)
    assert cluster.knee(spark.createDataFrame([], "k bigint, wcss bigint")).collect() == []


def test_cut_of_the_ensembles_own_linkage(spark, sf_dir):
    """The dendrogram of real districts, cut by following its merges one by one."""
    from tesserapy.plans.queries import Ensemble, _linkage

    e = Ensemble(spark, sf_dir)
    rows, n = _linkage(spark, e)
    found = [tuple(r) for r in rows.orderBy("step").collect()]
    d = {(r["i"], r["j"]): r["d"] for r in distance.pair_distances(e.districts, e.weights).collect()}
    assert found == brute([[d.get((max(i, j), min(i, j)), 0) for j in range(n)] for i in range(n)])
    for k in (12, 5, 1, n):
        groups = {v: {v} for v in range(n)}
        for step, a, b, _, _ in found[: n - k if 0 < k < n else n - 1]:
            groups[n + step] = groups.pop(a) | groups.pop(b)
        want = {v: c for c, root in enumerate(sorted(groups)) for v in groups[root]}
        assert {r["district_uid"]: r["cluster_id"] for r in cluster.cut_linkage(rows, k, n).collect()} == want
    members = [list(r["members"]) for r in e.districts.orderBy("district_uid").collect()]
    one = e.weights.first()
    curve = {r["k"]: r["wcss"] for r in cluster.elbow_curve(e.districts, rows, e.weights, n).collect()}
    assert curve == cuts_wcss(members, one["weights"], one["cap"], [(a, b) for _, a, b, _, _ in found], n)


@pytest.mark.parametrize("bound", [0, 3, 8, 30])
def test_near_pairs_equal_all_pairs_within(spark, bound):
    rng = np.random.default_rng(bound)
    members = [sorted(map(int, rng.choice(12, rng.integers(0, 7), replace=False))) for _ in range(70)]
    weights = [int(x) for x in rng.integers(0, 7, 12)]
    districts = spark.createDataFrame(list(enumerate(members)), "district_uid bigint, members array<int>")
    one = spark.createDataFrame([(weights, 9)], "weights array<bigint>, cap bigint")
    want = {(i, j): x for i in range(70) for j in range(i) if (x := sum(weights[p] for p in set(members[i]) ^ set(members[j]))) <= bound}
    assert {(r["i"], r["j"]): r["d"] for r in distance.near_pairs(districts, one, bound).collect()} == want
    assert distance.near_candidates(districts, one, bound).count() >= len(want)


def test_near_candidates_are_far_fewer_than_pairs(spark):
    rng = np.random.default_rng(1)
    members = [sorted(map(int, rng.choice(400, 20, replace=False))) for _ in range(300)]
    members += [sorted({*m[:-1], 400}) for m in members[:50]]
    districts = spark.createDataFrame(list(enumerate(members)), "district_uid bigint, members array<int>")
    one = spark.createDataFrame([([1] * 401, 100)], "weights array<bigint>, cap bigint")
    assert distance.near_pairs(districts, one, 4).count() >= 50
    assert distance.near_candidates(districts, one, 4).count() < 350 * 349 / 2 / 10


@pytest.mark.parametrize("bins", [2, 3, 1024])
def test_ordered_values_by_refining_histograms(spark, bins):
    rng = np.random.default_rng(bins)
    values = [int(x) for x in [*rng.integers(-50, 50, 200), *[7] * 100, 10**12, -(10**9)]]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(3)
    ranks = [0, 1, 5, 150, 150, 200, len(values) - 2, len(values) - 1]
    assert distance.ordered_values(df, ranks, bins) == {r: sorted(values)[r] for r in ranks}
    with pytest.raises(ValueError):
        distance.ordered_values(df, [len(values)])


@pytest.mark.parametrize("bins", [1, 4, 50])
def test_quantile_edges_are_linear_quantiles(spark, bins):
    rng = np.random.default_rng(bins)
    d = [int(x) for x in rng.integers(0, 30, 90)]
    got = distance.quantile_edges(spark.createDataFrame([(x,) for x in d], "d bigint"), 25, bins).first()["edges"]
    padded = [-1, 26, *[x for x in d if x < 25]]
    assert got == sorted({int(x) for x in np.quantile(padded, np.linspace(0, 1, bins + 1))})
    assert distance.quantile_edges(spark.createDataFrame([], "d bigint"), 25, 2).first()["edges"] == [-1, 12, 26]
