import gzip
import json
from collections import Counter

import pytest

from tesserapy.operators.sampler import Chain, Settings, parse_args, sample_plans

GRID = [(v, v + 1) for v in range(9) if v % 3 < 2] + [(v, v + 3) for v in range(6)]


def connected(plan):
    near = {v: set() for v in range(9)}
    for a, b in GRID:
        near[a].add(b)
        near[b].add(a)
    for d in set(plan):
        inside = {v for v in range(9) if plan[v] == d}
        seen = [next(iter(inside))]
        for v in seen:
            seen += [u for u in near[v] if u in inside and u not in seen]
        if set(seen) != inside:
            return False
    return True


def test_plans_stay_connected_and_balanced(spark):
    settings = Settings(pop_dev=0.34, cycle_walk_steps=60, cycle_walk_out_freq=5)
    rows = sample_plans(spark, [1] * 9, GRID, 3, settings, chains=2).collect()
    assert len(rows) == 24
    for r in rows:
        assert connected(r["plan_vector"]) and set(Counter(r["plan_vector"]).values()) <= {2, 3, 4}


def test_chain_weighs_partitions_by_their_forests():
    """On a 2 x 3 grid in two halves of three, a partition's share goes with its number of forests."""
    edges = [(0, 1), (1, 2), (3, 4), (4, 5), (0, 3), (1, 4), (2, 5)]
    chain = Chain([1] * 6, edges, 2, Settings(pop_dev=0.01), 7)
    seen = Counter()
    for _ in range(30000):
        chain.two_tree() if chain.rng.random() < 0.5 else chain.one_tree()
        seen[frozenset((frozenset(v for v in range(6) if chain.home[v] == d)) for d in (0, 1))] += 1
    assert len(seen) == 3
    share = [n / 30000 for n in seen.values()]
    assert all(abs(s - 1 / 3) < 0.05 for s in share)


def test_infeasible_deviation_and_arguments():
    with pytest.raises(ValueError, match="at least"):
        Chain([1] * 10, [(k, k + 1) for k in range(9)], 3, Settings(pop_dev=0.01), 1)
    name, out, s = parse_args(["--map_file", "m.json", "--output_file", "o.jsonl.gz", "--run_diagnostics", "true"])
    assert (name, out, s.run_diagnostics, s.steps, s.every, s.rng_seed) == ("m.json", "o.jsonl.gz", True, 10000, 1000, 4541901234)
    for bad in (["--map_file", "m"], ["--map_file", "m", "--output_file", "o.json"], ["--map_file", "m", "--output_file", "o.jsonl.gz", "--other", "1"]):
        with pytest.raises(SystemExit):
            parse_args(bad)


def test_command_line_writes_an_atlas_that_can_be_read(spark, tmp_path):
    from tesserapy.operators import grid
    from tesserapy.operators.sampler import main
    from tesserapy.sources import atlas, graph

    path, out = str(tmp_path / "map.json"), str(tmp_path / "atlas.jsonl.gz")
    graph.write_graph(grid.grid_nodes(spark, 3), grid.grid_edges(spark, 3), path, 3)
    rows = main(spark, ["--map_file", path, "--output_file", out, "--pop_dev", "0.34", "--cycle_walk_steps", "30", "--cycle_walk_out_freq", "10", "--run_diagnostics", "true"])
    made = rows.orderBy("step").collect()
    assert [r["step"] for r in made] == [100, 200, 300] and 0 < made[0]["accepted_one"] <= 1 and made[0]["log_forests"] >= 0 and made[0]["isoperimetric"] > 0
    assert made[0]["cycle_length"] >= 4 and made[0]["delta_nodes"] >= 0
    records = [json.loads(x) for x in gzip.open(out, "rt")][3:]
    assert [(r["data"]["log_forests"], r["data"]["isoperimetric"]) for r in records] == [(r["log_forests"], r["isoperimetric"]) for r in made]
    lines = atlas.read_lines(spark, [out])
    assert atlas.header_districts(lines) == 3
    labels = graph.labels(graph.precincts(graph.read_graph(spark, path)))
    back = atlas.read_samples(lines, labels, 9, 100).orderBy("step").collect()
    assert [(r["step"], r["plan_vector"], r["sample_tag"]) for r in back] == [(r["step"], r["plan_vector"], "atlas") for r in made]
