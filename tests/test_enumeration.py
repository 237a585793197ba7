"""Counts of balanced partitions against all assignments."""

import itertools

import pytest

from tesserapy.operators import enumeration


def brute(population, width, districts, low, high):
    n, found = len(population), set()
    near = [[q for q in (p - 1 if p % width else -1, p + 1 if p % width < width - 1 else -1, p - width, p + width) if 0 <= q < n] for p in range(n)]
    for labels in itertools.product(range(districts), repeat=n):
        first = list(dict.fromkeys(labels))
        if first != list(range(districts)):
            continue
        for d in range(districts):
            own = {p for p in range(n) if labels[p] == d}
            reach, todo = set(), [min(own)]
            while todo:
                p = todo.pop()
                if p not in reach:
                    reach.add(p)
                    todo += [q for q in near[p] if q in own]
            if reach != own or not low <= sum(population[p] for p in own) <= high:
                break
        else:
            found.add(labels)
    return len(found)


def local(population, width, districts, low, high):
    """The same states merged in a dictionary, without Spark."""
    states = {((), (), frozenset(), 0): 1}
    for k, people in enumerate(population):
        new = {}
        for s, ways in states.items():
            for t in enumeration.grown(s, k % width, k < width, people, low, high, districts):
                new[t] = new.get(t, 0) + ways
        states = new
    return sum(w for (_, sizes, _, closed), w in states.items() if closed + len(sizes) == districts and all(low <= p <= high for p in sizes))


@pytest.mark.parametrize(("population", "width", "districts", "low", "high"), [([1] * 6, 2, 2, 3, 3), ([1] * 9, 3, 3, 3, 3), ([1] * 9, 3, 3, 1, 9), ([1] * 12, 4, 2, 6, 6), ([3, 1, 4, 1, 5, 9, 2, 6, 5], 3, 2, 12, 24), ([1] * 12, 4, 3, 4, 4), ([2, 7, 1, 8, 2, 8], 3, 6, 1, 9), ([1] * 4, 1, 2, 1, 3)])
def test_counts_equal_all_assignments(population, width, districts, low, high):
    assert local(population, width, districts, low, high) == brute(population, width, districts, low, high)


def test_known_counts():
    assert local([1] * 16, 4, 2, 8, 8) == 70 and local([1] * 16, 4, 4, 4, 4) == 117


def test_rows_give_what_a_dictionary_gives(spark):
    people = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8]
    for districts, low, high in ((2, 20, 32), (3, 13, 21)):
        row = enumeration.partition_counts(spark, people, 4, districts, low, high).first()
        assert row["ways"] == local(people, 4, districts, low, high) == brute(people, 4, districts, low, high) > 0
    assert enumeration.partition_counts(spark, [1, 1], 2, 2, 5, 9).first()["ways"] == 0
    with pytest.raises(ValueError):
        enumeration.partition_counts(spark, [1, 1, 1], 2, 2, 1, 2)
