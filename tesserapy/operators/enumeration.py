"""Exact number of balanced partitions of a grid, by a frontier of states.

Cells are taken row by row. What the cells so far can look like to the rest is a
state: the parts that the frontier (the last cell of each column) belongs to, the
population of each, which of them must stay apart, and how many parts are closed.
States are rows; a step turns each into those that one more cell allows, and equal
ones are merged by a sum of their ways. So the work follows the number of
different states, not the number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import checkpoint

STATE = "labels array<int>, people array<bigint>, apart array<int>, closed int, ways bigint"
#: An apart pair (a, b) with a < b is the number a * PARTS + b; a frontier holds fewer parts.
PARTS = 64

State = tuple[tuple[int, ...], tuple[int, ...], frozenset, int]


def grown(state: State, column: int, first_row: bool, people: int, low: int, high: int, most: int) -> Iterator[State]:
    """The states after one more cell: in a part of its own, or that of the cell left of it, above it, or both."""
    labels, sizes, apart, closed = state
    left = labels[column - 1] if column else None
    up = None if first_row else labels[column]
    near = {x for x in (left, up) if x is not None}
    for joined in ({*()}, *({x} for x in near), *([near] if len(near) == 2 else [])):
        if len(joined) == 2 and tuple(sorted(joined)) in apart:
            continue
        part = min(joined, default=len(sizes))
        total = people + sum(sizes[x] for x in joined)
        if total > high:
            continue
        names = {x: part for x in joined}
        row = [names.get(x, x) for x in labels]
        if column < len(row):
            row[column] = part
        else:
            row.append(part)
        by_part = {x: s for x, s in enumerate(sizes) if x not in joined} | {part: total}
        pairs = {tuple(sorted((names.get(a, a), names.get(b, b)))) for a, b in apart} | {tuple(sorted((part, x))) for x in near - joined}
        done = closed
        gone = set(by_part) - set(row)
        if any(not low <= by_part[x] <= high for x in gone) or (done := closed + len(gone)) > most:
            continue
        order = {x: k for k, x in enumerate(dict.fromkeys(row))}
        kept = frozenset(tuple(sorted((order[a], order[b]))) for a, b in pairs if a in order and b in order)
        yield tuple(order[x] for x in row), tuple(by_part[x] for x in order), kept, done


def partition_counts(spark: SparkSession, population: list[int], width: int, districts: int, low: int, high: int) -> DataFrame:
    """One row: districts, low, high, ways: partitions of a grid of cells (row by row) into connected parts with populations from low to high.

    The populations are a number for each cell of the grid. Ways are those of
    unlabelled parts.
    """
    if len(population) % width:
        raise ValueError("the cells do not fill rows of this width")

    def take(cell: int):
        column, first, people = cell % width, cell < width, population[cell]

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out: dict[State, int] = {}
                for labels, sizes, apart, closed, ways in pdf.itertuples(index=False):
                    state = (tuple(labels), tuple(sizes), frozenset(divmod(int(x), PARTS) for x in apart), closed)
                    for new in grown(state, column, first, people, low, high, districts):
                        out[new] = out.get(new, 0) + ways
                rows = [(list(s[0]), list(s[1]), sorted(a * PARTS + b for a, b in s[2]), s[3], n) for s, n in out.items()]
                yield pd.DataFrame(rows, columns=["labels", "people", "apart", "closed", "ways"])

        return work

    states = spark.createDataFrame([([], [], [], 0, 1)], STATE)
    for cell in range(len(population)):
        states = states.mapInPandas(take(cell), STATE).groupBy("labels", "people", "apart", "closed").agg(F.sum("ways").alias("ways"))
        if cell % width == width - 1:
            states = checkpoint(states)
    good = F.forall("people", lambda p: (p >= low) & (p <= high)) & (F.col("closed") + F.size("people") == districts)
    return states.where(good).agg(F.lit(districts).alias("districts"), F.lit(low).cast("bigint").alias("low"), F.lit(high).cast("bigint").alias("high"), F.coalesce(F.sum("ways"), F.lit(0)).alias("ways"))
