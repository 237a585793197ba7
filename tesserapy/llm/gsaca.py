"""Suffix arrays by linear grouping.

Suffixes are first put into groups by their Lyndon prefix. Groups are processed
in descending order: each member looks up the previous suffix of a lower group
through previous-smaller pointers, and the prefix of that suffix grows by the
group's own prefix, which moves it to the upper end of its group. Once all
groups are processed they are final and in order. The second phase walks the
suffix array upwards and hands the next free slot of its group to every suffix
whose next smaller suffix has just been placed; no string is renamed and nothing
recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an integer sequence, in lexicographic order."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(text, kind="stable")
    ranked = np.asarray(text)[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    group_of_slot = starts[np.cumsum(new) - 1]
    by_suffix = np.empty(n, np.int64)
    by_suffix[order] = group_of_slot
    slot_of = np.empty(n, np.int64)
    slot_of[order] = np.arange(n)
    sa, group, slot = order.tolist(), by_suffix.tolist(), slot_of.tolist()
    last = [0] * n
    for a, b in zip(starts.tolist(), np.append(starts[1:], n).tolist(), strict=True):
        last[a] = b - 1
    smaller = [-1] * n
    _group(sa, group, slot, last, smaller)
    return np.array(_order(n, group, smaller), np.int64)


def _group(sa: list[int], group: list[int], slot: list[int], last: list[int], smaller: list[int]) -> None:
    """First phase: refine ``group`` (first slot of each suffix's group) and fill ``smaller``."""
    end = len(sa) - 1
    while end >= 0:
        first = group[sa[end]]
        if first == end:
            s = sa[end]
            p = s - 1
            while p >= 0 and group[p] > first:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                g = group[p]
                e = last[g]
                if e != g:
                    q, at = sa[e], slot[p]
                    sa[at], slot[q] = q, at
                    sa[e], slot[p] = p, e
                    group[p] = last[e] = e
                    last[g] = e - 1
            end -= 1
            continue
        grown: dict[int, int] = {}
        for s in sorted(sa[first : end + 1]):
            p = s - 1
            while p >= 0 and group[p] > first:
                p = smaller[p]
            if p >= 0 and group[p] == first:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                grown[p] = grown.get(p, 0) + 1
        shares: dict[int, list[tuple[int, int]]] = {}
        for p, times in grown.items():
            shares.setdefault(group[p], []).append((times, p))
        for g, moved in shares.items():
            moved.sort(reverse=True)
            e, k = last[g], 0
            while k < len(moved):
                times, top, k0 = moved[k][0], e, k
                while k < len(moved) and moved[k][0] == times:
                    p = moved[k][1]
                    q, at = sa[e], slot[p]
                    sa[at], slot[q] = q, at
                    sa[e], slot[p] = p, e
                    e -= 1
                    k += 1
                for _, p in moved[k0:k]:
                    group[p] = e + 1
                last[e + 1] = top
            if e >= g:
                last[g] = e
        end = first - 1


def _order(n: int, group: list[int], smaller: list[int]) -> list[int]:
    """Second phase: fill the groups' slots in ascending order."""
    out, free, placed = [0] * n, list(range(n)), bytearray(n)
    s, done = n, 0
    while True:
        p = s - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            k = free[g]
            # The next free slot of a group is kept at the group's first slot.
            out[k] = p
            free[g] = k + 1
            placed[p] = 1
            p = smaller[p]
        if done == n:
            return out
        s = out[done]
        done += 1
