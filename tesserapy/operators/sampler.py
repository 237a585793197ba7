"""Markov chain sampling of plans by walks on spanning forests.

A state is a spanning forest with one tree for each district. Nine steps of ten
stay in a tree: an edge is added inside a district and a random edge of the cycle
it closes is removed. One step of ten joins two districts by two of the edges
between them, which closes a cycle through both trees, and cuts the cycle at two
edges so that both parts keep their population in range. The cycle and its
balanced cuts are the same seen from the new state, so only the choices of the
districts and of the two edges enter the acceptance ratio, beside the target.

Chains are independent: one row of seeds is one chain.
"""

from __future__ import annotations

import argparse
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from ..sources.atlas import write_samples
from ..sources.graph import edges as edges_of
from ..sources.graph import precincts, read_graph
from ..sources.shared import checkpoint

#: Scores of a sample.
SCORES = ("log_forests", "isoperimetric")
#: Share of steps that change the partition.
TWO_TREE = 0.1


@dataclass
class Settings:
    """Options of a run; the names are those of the command line."""

    pop_dev: float = 0.02
    gamma: float = 0.0
    iso_weight: float = 0.0
    cycle_walk_steps: float = 1e3
    cycle_walk_out_freq: int = 100
    run_diagnostics: bool = False
    rng_seed: int = 4541901234

    @property
    def steps(self) -> int:
        return math.ceil(self.cycle_walk_steps / TWO_TREE)

    @property
    def every(self) -> int:
        return max(1, math.floor(self.cycle_walk_out_freq / TWO_TREE))


def parse_args(args: list[str]) -> tuple[str, str, Settings]:
    """map_file, output_file and settings; unknown options and missing values are errors."""
    parser = argparse.ArgumentParser(prog="sampler", allow_abbrev=False)
    flag = lambda text: {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}[text.lower()]
    parser.add_argument("--map_file", required=True)
    parser.add_argument("--output_file", required=True)
    for name, kind in (("pop_dev", float), ("gamma", float), ("iso_weight", float), ("cycle_walk_steps", float), ("cycle_walk_out_freq", int), ("run_diagnostics", flag), ("rng_seed", int)):
        parser.add_argument(f"--{name}", type=kind, default=getattr(Settings(), name))
    got = vars(parser.parse_args(args))
    if not got["output_file"].endswith(".jsonl.gz"):
        parser.error("output_file must end in .jsonl.gz")
    return got.pop("map_file"), got.pop("output_file"), Settings(**got)


class Chain:
    """A forest over a graph of precincts, and its moves."""

    def __init__(self, weights: list[int], edges: list[tuple[int, int]], districts: int, settings: Settings, seed: int):
        self.w, self.k, self.set, self.rng = weights, districts, settings, random.Random(seed)
        self.n = len(weights)
        self.edges = sorted({(min(a, b), max(a, b)) for a, b in edges if a != b})
        self.near: list[list[int]] = [[] for _ in range(self.n)]
        for a, b in self.edges:
            self.near[a].append(b)
            self.near[b].append(a)
        mean = sum(weights) / districts
        self.low, self.high = mean * (1 - settings.pop_dev), mean * (1 + settings.pop_dev)
        if math.floor(self.high + 1e-9) < math.ceil(self.low - 1e-9):
            least = min(abs(math.floor(mean) - mean), abs(math.ceil(mean) - mean)) / mean
            raise ValueError(f"no whole population is within pop_dev; it must be at least {least:.6g}")
        self.tried = {"one": 0, "two": 0}
        self.taken = {"one": 0, "two": 0}
        self.cycles, self.moved = [0, 0], [0, 0]  # number and total: nodes of the cycles met, nodes that accepted steps moved
        self.home, self.tree = self._start()

    def balanced(self, population: float) -> bool:
        return self.low - 1e-9 <= population <= self.high + 1e-9

    def _spanning_tree(self, inside: list[int]) -> dict[int, set[int]]:
        """A random tree of a connected set, by loop-erased walks."""
        members = set(inside)
        tree: dict[int, set[int]] = {v: set() for v in inside}
        done = {inside[self.rng.randrange(len(inside))]}
        for v in inside:
            path = {}
            x = v
            while x not in done:
                path[x] = self.rng.choice([u for u in self.near[x] if u in members])
                x = path[x]
            x = v
            while x not in done:
                done.add(x)
                tree[x].add(path[x])
                tree[path[x]].add(x)
                x = path[x]
        return tree

    def _start(self, tries: int = 20000):
        """A balanced plan by cutting districts off random spanning trees."""
        for _ in range(tries):
            rest, home, ok = list(range(self.n)), [0] * self.n, True
            for d in range(self.k - 1):
                tree = self._spanning_tree(rest)
                root = rest[0]
                order, parent = [root], {root: -1}
                for v in order:
                    for u in tree[v]:
                        if u not in parent:
                            parent[u] = v
                            order.append(u)
                below = {v: self.w[v] for v in rest}
                for v in reversed(order[1:]):
                    below[parent[v]] += below[v]
                cuts = [v for v in order[1:] if self.balanced(below[v])]
                if not cuts:
                    ok = False
                    break
                top = self.rng.choice(cuts)
                part = [top]
                for v in part:
                    part += [u for u in tree[v] if parent.get(u) == v]
                for v in part:
                    home[v] = d
                gone = set(part)
                rest = [v for v in rest if v not in gone]
            if ok and self.balanced(sum(self.w[v] for v in rest)):
                for v in rest:
                    home[v] = self.k - 1
                tree: list[set[int]] = [set() for _ in range(self.n)]
                for d in range(self.k):
                    for v, near in self._spanning_tree([v for v in range(self.n) if home[v] == d]).items():
                        tree[v] = near
                return home, tree
        raise ValueError("no balanced start was found; a larger pop_dev may be needed")

    def _path(self, a: int, b: int) -> list[int]:
        """Nodes of the tree path from a to b."""
        back, order = {a: a}, [a]
        for v in order:
            if v == b:
                break
            for u in self.tree[v]:
                if u not in back:
                    back[u] = v
                    order.append(u)
        out = [b]
        while out[-1] != a:
            out.append(back[out[-1]])
        return out[::-1]

    def _swap(self, add: list[tuple[int, int]], cut: list[tuple[int, int]]) -> None:
        for a, b in add:
            self.tree[a].add(b)
            self.tree[b].add(a)
        for a, b in cut:
            self.tree[a].discard(b)
            self.tree[b].discard(a)

    def one_tree(self) -> None:
        self.tried["one"] += 1
        a, b = self.rng.choice(self.edges)
        if self.home[a] != self.home[b] or b in self.tree[a]:
            return
        path = self._path(a, b)
        k = self.rng.randrange(len(path))
        if k == len(path) - 1:
            return
        self._swap([(a, b)], [(path[k], path[k + 1])])
        self.taken["one"] += 1

    def _between(self) -> dict[tuple[int, int], list[tuple[int, int]]]:
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for a, b in self.edges:
            x, y = self.home[a], self.home[b]
            if x != y:
                out.setdefault((min(x, y), max(x, y)), []).append((a, b) if x < y else (b, a))
        return {key: e for key, e in out.items() if len(e) > 1}

    def log_trees(self, d: int) -> float:
        """Logarithm of the number of spanning trees of a district."""
        inside = [v for v in range(self.n) if self.home[v] == d]
        place = {v: k for k, v in enumerate(inside)}
        lap = np.zeros((len(inside), len(inside)))
        for v in inside:
            for u in self.near[v]:
                if u in place:
                    lap[place[v], place[v]] += 1
                    lap[place[v], place[u]] -= 1
        return float(np.linalg.slogdet(lap[1:, 1:])[1]) if len(inside) > 1 else 0.0

    def isoperimetric(self, d: int) -> float:
        """Squared number of border edges over the number of precincts."""
        inside = [v for v in range(self.n) if self.home[v] == d]
        return sum(self.home[u] != d for v in inside for u in self.near[v]) ** 2 / len(inside)

    def energy(self, districts: tuple[int, int]) -> float:
        """Part of the target's energy that two districts change."""
        trees = sum(map(self.log_trees, districts)) if self.set.gamma else 0.0
        shape = sum(map(self.isoperimetric, districts)) if self.set.iso_weight else 0.0
        return self.set.gamma * trees + self.set.iso_weight * shape

    def two_tree(self) -> None:
        self.tried["two"] += 1
        pairs = self._between()
        if not pairs:
            return
        key = self.rng.choice(sorted(pairs))
        x, y = key
        (a1, b1), (a2, b2) = self.rng.sample(pairs[key], 2)
        left, right = self._path(a2, a1), self._path(b1, b2)
        cycle = left + right
        m = len(cycle)
        self.cycles = [self.cycles[0] + 1, self.cycles[1] + m]
        # What hangs on each node of the cycle, the cycle's own edges aside.
        on = set(cycle)
        mass, hung = [], []
        for v in cycle:
            part = [v]
            seen = {v}
            for u in part:
                for t in self.tree[u]:
                    if t not in seen and t not in on:
                        seen.add(t)
                        part.append(t)
            hung.append(part)
            mass.append(sum(self.w[u] for u in part))
        total, run = sum(mass), np.concatenate([[0], np.cumsum(mass)])
        # Cut i is the edge before node i of the cycle; cuts i < j part off nodes i .. j - 1.
        good = [(i, j) for i in range(m) for j in range(i + 1, m) if self.balanced(run[j] - run[i]) and self.balanced(total - (run[j] - run[i]))]
        if not good:
            return
        i, j = self.rng.choice(good)
        before = len(pairs) * math.comb(len(pairs[key]), 2)
        energy = self.energy(key)
        old_home = {u: self.home[u] for part in hung for u in part}
        edge = lambda c: (cycle[c - 1], cycle[c])
        inner = {u for part in hung[i:j] for u in part}
        # The part that keeps more of the first district keeps its label.
        first = sum(self.home[u] == x for u in inner)
        rest = [u for u in old_home if u not in inner]
        keep = first >= sum(self.home[u] == x for u in rest)
        for u in old_home:
            self.home[u] = x if (u in inner) == keep else y
        self._swap([(a1, b1), (a2, b2)], [edge(i), edge(j)])
        after_pairs = self._between()
        after = len(after_pairs) * math.comb(len(after_pairs.get(key, [])), 2)
        log = math.log(before) - math.log(after) + energy - self.energy(key) if after else -math.inf
        if log >= 0 or self.rng.random() < math.exp(log):
            self.taken["two"] += 1
            self.moved = [self.moved[0] + 1, self.moved[1] + sum(self.home[u] != d for u, d in old_home.items())]
            return
        self._swap([edge(i), edge(j)], [])
        self._swap([], [e for e in ((a1, b1), (a2, b2))])
        for u, d in old_home.items():
            self.home[u] = d

    def run(self) -> Iterator[tuple[int, list[int], float, float]]:
        """(step, plan, log of the number of forests, isoperimetric score) as often as the settings say."""
        for step in range(1, self.set.steps + 1):
            self.two_tree() if self.rng.random() < TWO_TREE else self.one_tree()
            if step % self.set.every == 0:
                every = range(self.k)
                yield step, list(self.home), sum(map(self.log_trees, every)), sum(map(self.isoperimetric, every))

    def diagnostics(self) -> dict[str, float]:
        """Share of accepted steps of each kind, mean nodes of a cycle, and mean nodes that an accepted step moves."""
        share = {f"accepted_{kind}": self.taken[kind] / self.tried[kind] if self.tried[kind] else 0.0 for kind in self.tried}
        means = {"cycle_length": self.cycles, "delta_nodes": self.moved}
        return share | {name: total / n if n else 0.0 for name, (n, total) in means.items()}


DIAGNOSTICS = ("accepted_one", "accepted_two", "cycle_length", "delta_nodes")
SAMPLE = "chain int, step bigint, plan_vector array<int>, log_forests double, isoperimetric double, " + ", ".join(f"{c} double" for c in DIAGNOSTICS)


def sample_plans(spark: SparkSession, weights: list[int], edges: list[tuple[int, int]], districts: int, settings: Settings, chains: int = 1) -> DataFrame:
    """chain, step, plan_vector, scores, and the chain's diagnostics (null unless asked for).

    A task runs a chain; the graph goes with the task.
    """
    ship(spark)
    seeds = spark.range(chains).selectExpr("cast(id as int) as chain").repartition(chains, "chain")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for k in pdf["chain"]:
                chain = Chain(weights, edges, districts, settings, settings.rng_seed + int(k))
                rows = list(chain.run())
                found = chain.diagnostics() if settings.run_diagnostics else dict.fromkeys(DIAGNOSTICS)
                out = pd.DataFrame(rows, columns=["step", "plan_vector", *SCORES])
                yield out.assign(chain=np.int32(k), **found).astype(dict.fromkeys(DIAGNOSTICS, float))

    return seeds.mapInPandas(walk, SAMPLE)


def main(spark: SparkSession, args: list[str]) -> DataFrame:
    """Run one chain over a graph document and write it as an atlas; returns the samples."""
    map_file, output_file, settings = parse_args(args)
    doc = read_graph(spark, map_file)
    nodes = precincts(doc)
    people = [int(r["population"]) for r in nodes.orderBy("precinct_idx").collect()]
    pairs = [(r["src"], r["dst"]) for r in edges_of(doc).collect()]
    districts = int(doc.first()["num_districts"])
    rows = sample_plans(spark, people, pairs, districts, settings)
    rows = checkpoint(rows)
    header = {"districts": districts, "popdev": settings.pop_dev, "gamma": settings.gamma, "iso_weight": settings.iso_weight}
    names = nodes.select("precinct_idx", F.col("precinct_id_str").alias("label"))
    write_samples(rows, names, output_file, header, listed_keys=True, scores=SCORES, one_file=True)
    return rows
