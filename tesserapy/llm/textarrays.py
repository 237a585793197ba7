"""Texts as numpy arrays of code points, in chunks of bounded size."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Texts are handled in chunks of about this many characters (one text at least).
CHUNK = 1 << 20

LETTER, UPPER, DIGIT, BLANK, MARK = 1, 2, 4, 8, 16

#: Code point ranges (first, last) of scripts.
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F), (0xA8E0, 0xA8FF))),
    ("bengali", ((0x980, 0x9FF),)),
    ("gurmukhi", ((0xA00, 0xA7F),)),
    ("gujarati", ((0xA80, 0xAFF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("telugu", ((0xC00, 0xC7F),)),
    ("kannada", ((0xC80, 0xCFF),)),
    ("malayalam", ((0xD00, 0xD7F),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("ethiopic", ((0x1200, 0x139F),)),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Flags of every code point."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            out[c] = LETTER | (UPPER if kind == "Lu" else 0)
        elif kind == "Nd":
            out[c] = DIGIT
        elif kind[0] in "PS":
            out[c] = MARK
    out[[0x20, *range(0x09, 0x0E)]] = BLANK
    return out


@lru_cache(maxsize=1)
def lowered() -> np.ndarray:
    """The lower-case form of every letter of one code point; 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in np.flatnonzero(classes() & LETTER).tolist():
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(maxsize=1)
def scripts() -> np.ndarray:
    """The script of every code point: its place in SCRIPTS plus 1, else 0."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for k, (_, ranges) in enumerate(SCRIPTS):
        for a, b in ranges:
            out[a : b + 1] = k + 1
    return out


def chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, code points, bounds) of consecutive texts; null reads as empty."""
    k = 0
    while k < len(texts):
        end, size = k, 0
        while end < len(texts) and (end == k or size + len(texts[end] or "") <= most):
            size += len(texts[end] or "")
            end += 1
        part = [t or "" for t in texts[k:end]]
        bounds = np.zeros(len(part) + 1, np.int64)
        np.cumsum([len(t) for t in part], out=bounds[1:])
        yield k, end, np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32), bounds
        k = end


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums over [start, end) ranges, as floats."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


_STEP = 0x9E3779B97F4A7C15


class _Powers:
    """Powers of an odd number and of its inverse, as many as were asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            cls.up, cls.down = np.ones(n, np.uint64), np.ones(n, np.uint64)
            cls.up[1:] = np.cumprod(np.full(n - 1, _STEP, np.uint64))
            cls.down[1:] = np.cumprod(np.full(n - 1, pow(_STEP, -1, 1 << 64), np.uint64))
        return cls.up[:n], cls.down[:n]


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each [start, end) run of code points (the same anywhere).

    Each code point is weighed by a power of an odd number for its place, so the
    sum of a run is a difference of running sums, brought back to place zero.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _Powers.of(len(codes))
    total = np.zeros(len(codes) + 1, np.uint64)
    weighed = codes.astype(np.uint64)
    weighed += np.uint64(1)
    weighed *= up
    np.cumsum(weighed, out=total[1:])
    return mix(mix((total[ends] - total[starts]) * down[starts]) + (ends - starts).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def runs(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags; no run crosses a bound."""
    n = len(flags)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.zeros(n + 1, bool)
    fresh[bounds[:-1][bounds[:-1] < n]] = True
    starts = flags.copy()
    starts[1:] &= ~flags[:-1] | fresh[1:n]
    stops = flags.copy()
    stops[:-1] &= ~flags[1:] | fresh[1:n]
    return np.flatnonzero(starts), np.flatnonzero(stops) + 1
