"""Texts of an Arrow batch as flat arrays of code points, for measures that need no Python object for a word or a character."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Code points that are handled at a time; a longer text is handled alone.
STRETCH = 1 << 20

_STEP = 0x9E3779B97F4A7C15


@cache
def _powers() -> list[np.ndarray]:
    return [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _up_to(n: int) -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    tables = _powers()
    if len(tables[0]) < n:
        for i, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            table = np.full(max(n, STRETCH), base, np.uint64)
            table[0] = 1
            tables[i] = np.multiply.accumulate(table)
    return tables


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def span_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, equal for equal spans wherever they stand."""
    up, down = _up_to(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(scramble(points) * up[: len(points)], out=total[1:])
    return scramble((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@cache
def categories() -> np.ndarray:
    """Of each code point, the first letter of its general category, as a byte."""
    return np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)).encode(), np.uint8)


def stretches(texts: list[str]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, code points, offsets) of consecutive texts of about STRETCH code points together."""
    first = 0
    while first < len(texts):
        stop, size = first, 0
        while stop < len(texts) and (stop == first or size + len(texts[stop]) <= STRETCH):
            size += len(texts[stop])
            stop += 1
        part = texts[first:stop]
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        yield slice(first, stop), points, np.concatenate(([0], np.cumsum([len(t) for t in part])))
        first = stop


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets, 0 for empty stretches."""
    total = np.concatenate((np.zeros(1, values.dtype if values.dtype != bool else np.int64), np.cumsum(values)))
    return total[offs[1:]] - total[offs[:-1]]
