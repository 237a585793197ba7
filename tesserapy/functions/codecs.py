"""Codecs between index sets and strings, and weighted set distances, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cap of the dense distance unless another is given (the largest 32-bit integer).
INT_MAX = 2147483647


def vec_to_str(vec: Column) -> Column:
    """Sorted integers joined by dots; the empty set is the empty string."""
    return F.array_join(F.transform(F.array_sort(vec), lambda x: x.cast("string")), ".")


def str_to_vec(text: Column) -> Column:
    """Integers of a dotted string, in its order; the empty string is the empty set."""
    parts = F.filter(F.split(text, "[.]"), lambda x: x != "")
    return F.transform(parts, lambda x: x.cast("int"))


def indicator(vec: Column, size: Column) -> Column:
    """0/1 array of the given size with ones at the indices."""
    return F.transform(indices(size), lambda p: F.array_contains(vec, p).cast("int"))


def indices(size: Column) -> Column:
    """0, 1, ... size - 1 (empty for size 0)."""
    return F.when(size > 0, F.sequence(F.lit(0), (size - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def members_of(plan: Column, district: Column) -> Column:
    """Positions in a plan vector that belong to the district, ascending."""
    marked = F.transform(plan, lambda d, p: F.when(d == district, p))
    return F.filter(marked, lambda p: p.isNotNull())


def weight_of(vec: Column, weights: Column) -> Column:
    """Sum of the weights at the indices; 0 for the empty set."""
    return F.aggregate(vec, F.lit(0).cast("bigint"), lambda s, p: s + F.get(weights, p).cast("bigint"))


def set_distance(a: Column, b: Column, weight_a: Column, weight_b: Column, weights: Column, cap: Column | None = None) -> Column:
    """Weight of the symmetric difference: w(a) + w(b) - 2 w(a and b), capped."""
    out = weight_a + weight_b - F.lit(2) * weight_of(F.array_intersect(a, b), weights)
    out = F.greatest(out, F.lit(0).cast("bigint"))
    return out if cap is None else F.least(out, cap)


def sparse_l1(a: Column, b: Column, weights: Column, cap: Column) -> Column:
    """Weighted L1 distance of two index sets."""
    return set_distance(a, b, weight_of(a, weights), weight_of(b, weights), weights, cap)


def dense_l1(a: Column, b: Column, weights: Column, cap: int | Column | None = INT_MAX) -> Column:
    """Weighted L1 distance of two dense vectors, as a double; no cap if None."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    out = F.aggregate(F.zip_with(gaps, weights, lambda g, w: g * w), F.lit(0.0), lambda s, x: s + x)
    if cap is None:
        return out
    return F.least(out, (cap if isinstance(cap, Column) else F.lit(cap)).cast("double"))
