"""Vectorised text kernel shared by the training-data operators.

Everything here works on whole Arrow string batches as flat numpy arrays: one
byte buffer, document offsets into it, and word boundaries found with a lookup
table.  No per-word Python objects are made.

A *word* is a maximal run of characters other than space and U+0009..U+000D.
Those six separators are single ASCII bytes, so boundaries can be found on the
UTF-8 bytes directly.  A null text is an empty text.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; keeps the working arrays inside the caches
#: and bounds memory whatever the size of an Arrow batch.
BLOCK_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LONG_WORD = 256

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of them."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Block:
    """Some consecutive documents of a batch: bytes, offsets and words.

    ``first`` is the row of the first document in the batch, ``n`` the number of
    documents; ``offs`` has n + 1 byte offsets into ``buf``; ``start``/``end``
    are the words' byte offsets, ``word_offs`` the n + 1 offsets of documents
    into the words.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, first: int):
        self.buf, self.offs, self.first, self.n = buf, offs, first, len(offs) - 1
        self.start, self.end = self._bounds(_IS_SPACE[buf])
        self.word_offs = np.searchsorted(self.start, offs)
        self.n_words = np.diff(self.word_offs)

    def _bounds(self, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(self.buf)
        solid = np.zeros(size + 1, bool)
        np.logical_not(gap, out=solid[:size])
        edge = np.zeros(size + 1, bool)  # a document starts here
        edge[self.offs] = True
        before = np.zeros(size + 1, bool)
        before[1:] = solid[:size]
        start = np.flatnonzero(solid & (edge | ~before))
        end = np.flatnonzero(before & (edge | ~solid))
        return start, end

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def text(self, start: int, end: int) -> str:
        return self.buf[start:end].tobytes().decode("utf-8", "replace")


@functools.cache
def _trim():
    """The C library's call that gives free memory back, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: None


def lean(run):
    """A function of batches that gives memory back when it ends: an idle Python worker then holds little while others work."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        _trim()(0)

    return wrapped


def blocks(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[Block]:
    """Splits a string column into blocks of about BLOCK_BYTES; a longer document is a block."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offs, offs[row] + BLOCK_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), len(column))
        buf = raw[offs[row] : offs[stop]]
        yield Block(_LOWER[buf] if lower else buf, offs[row : stop + 1] - offs[row], row)
        row = stop


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    up, down = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[buf] * up[: len(buf)], out=total[1:])
    out = (total[end] - total[start]) * down[start]
    out = mix(out + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(end - start > _LONG_WORD):  # polynomial hashes modulo 2**64 are weak on long periodic spans
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(block: Block) -> np.ndarray:
    return span_hashes(block.buf, block.start, block.end)


_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes of the flat array (runs may cross documents)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= _STEP
        out += words[i : i + n]
    return mix(out + np.uint64(k))


def gram_starts(word_offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indices where a run of k words of one document starts, and each document's number of runs."""
    count = np.maximum(np.diff(word_offs) - k + 1, 0)
    return ragged(word_offs[:-1], count), count


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] of them), first[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(first - (ends - count), count)


def fold(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets, 0 for empty stretches (any numeric type)."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def unique_per_doc(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document and the new offsets."""
    parts, sizes = [], np.zeros(len(offs), np.int64)
    for i in range(len(offs) - 1):
        part = np.sort(values[offs[i] : offs[i + 1]])
        if len(part) > 1:
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        parts.append(part)
        sizes[i + 1] = len(part)
    return (np.concatenate(parts) if parts else values[:0]), np.cumsum(sizes)


def shingle_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's set of k-word shingles as sorted distinct hashes, with offsets.

    A document of 1 to k - 1 words has its whole sequence as its one shingle; a
    document without words has an empty set.
    """
    words = word_hashes(block)
    grams = gram_hashes(words, k)
    starts, count = gram_starts(block.word_offs, k)
    offs = np.concatenate(([0], np.cumsum(count)))
    values = grams[starts]
    short = np.flatnonzero((block.n_words > 0) & (block.n_words < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j, i in enumerate(short):
            part = words[block.word_offs[i] : block.word_offs[i + 1]]
            whole[j] = gram_hashes(part, len(part))[0]
        values = np.insert(values, offs[short], whole)
        count = count.copy()
        count[short] = 1
        offs = np.concatenate(([0], np.cumsum(count)))
    return unique_per_doc(values, offs)


def by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Rows, without their first column, of each stretch of equal values in it."""
    key, rows = None, []
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            for k, *row in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns), strict=True):
                if k != key and rows:
                    yield rows
                    rows = []
                key = k
                rows.append(row)
    if rows:
        yield rows
