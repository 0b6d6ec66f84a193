"""Token ids of whole texts through a per-worker dictionary of distinct pieces.

A tokenizer that never joins across white space can be run on distinct pieces
of text instead of running text: each new piece is tokenized once, and a text's
ids are gathered from the dictionary with array operations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import kernel


class PieceIds:
    """Ids of distinct byte pieces, found by 64-bit hash; forgets everything when it holds ``most`` pieces."""

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]], most: int = 1_500_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def lookup(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each piece)."""
        slot = self.slots(buf, start, end)
        size = self.size[slot]
        return self.ids[kernel.ragged(self.start[slot], size)], size

    def slots(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each piece's place in ``start`` and ``size``, valid until the next call."""
        hashes = kernel.span_hashes(buf, start, end)
        order = np.argsort(hashes)
        ranked = hashes[order]
        head = np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(ranked)]
        distinct, first = ranked[head], order[head]
        inverse = np.empty(len(hashes), np.int64)
        inverse[order] = np.cumsum(head) - 1
        if len(self.at) + len(distinct) > self.most:
            self.clear()
        keys = distinct.tolist()
        at = [self.at.get(k, -1) for k in keys]
        new = [i for i, a in enumerate(at) if a < 0]
        if new:
            data = buf.tobytes()
            made = self.encode([data[s:e] for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            count, total = len(self.at), sum(map(len, made))
            self.ids = self._room(self.ids, self.used + total)
            self.start, self.size = self._room(self.start, count + len(new)), self._room(self.size, count + len(new))
            sizes = np.array([len(m) for m in made], np.int64)
            self.ids[self.used : self.used + total] = np.concatenate(made) if total else 0
            self.start[count : count + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.size[count : count + len(new)] = sizes
            self.used += total
            for j, i in enumerate(new):
                self.at[keys[i]] = at[i] = count + j
        return np.array(at, np.int64)[inverse] if len(at) else np.zeros(0, np.int64)

    @staticmethod
    def _room(a: np.ndarray, need: int) -> np.ndarray:
        if need <= len(a):
            return a
        out = np.zeros(max(need, 2 * len(a)), a.dtype)
        out[: len(a)] = a
        return out
