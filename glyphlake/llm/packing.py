"""Best-fit packing of documents into sequences of bounded length.

The plan is made from the histogram of piece lengths alone, whose size is
bounded by the sequence length:

1. lengths are put into classes and patterns of two to four classes that fill a
   sequence are enumerated;
2. repeat counts of the patterns are fitted to the histogram by non-negative
   least squares and rounded down;
3. each pattern's repeats are filled with the longest lengths its classes still
   have, and all lengths that are left are packed, longest first, into the
   sequence with the least room that is enough: into the gaps of the patterns
   too, many equal sequences at a time.

The plan says for each length and range of ranks which sequences and place they
get; a piece finds its own by its rank among pieces of its length.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .scratch import Scratch, partitions
from .tokens import PieceIds

#: Classes that lengths are put into for the patterns.
CLASSES = 32


def nnls(a: np.ndarray, b: np.ndarray, sweeps: int = 300) -> np.ndarray:
    """Non-negative least squares by coordinate descent on the normal equations."""
    gram, target = a.T @ a, a.T @ b
    x, scale = np.zeros(a.shape[1]), np.maximum(np.diag(gram), 1e-12)
    slope = -target
    for _ in range(sweeps):
        worst = 0.0
        for j in range(len(x)):
            step = max(-x[j], -slope[j] / scale[j])
            if step:
                x[j] += step
                slope += gram[j] * step
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return x


def patterns(classes: int) -> list[tuple[int, ...]]:
    """Multisets of two to four classes (class c is worth c, 1 to classes) that sum to ``classes``."""
    out: list[tuple[int, ...]] = []

    def extend(part: tuple[int, ...], left: int) -> None:
        if not left:
            if len(part) > 1:
                out.append(part)
            return
        if len(part) == 4:
            return
        for c in range(min(left, part[-1] if part else classes - 1), 0, -1):
            if c * (4 - len(part)) >= left:
                extend((*part, c), left - c)

    extend((), classes)
    return out


def plan_packing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan of the fewest sequences among those with all, three quarters, half or a quarter of the fitted repeats."""
    return min((_plan(histogram, capacity, share) for share in (1.0, 0.75, 0.5, 0.25)), key=lambda plan: plan[1])


def _plan(histogram: dict[int, int], capacity: int, share: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, end rank, first sequence, offset), and the number of sequences.

    Pieces of ``length`` with ranks in [first, end) go to consecutive sequences
    from ``first sequence`` on, at ``offset``.  Work and size of the plan depend
    on the number of lengths, not of pieces.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> ranges [first, end) of sequences
    free: list[int] = []  # rooms that exist, sorted
    total = 0

    def add_room(room: int, first: int, end: int) -> None:
        if first < end:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(free, room)
            rooms[room].append((first, end))

    def place(length: int, first: int, count: int, room: int) -> None:
        rows.append((length, taken[length], taken[length] + count, first, capacity - room))
        taken[length] += count
        left[length] -= count
        if not left[length]:
            del left[length]

    # Patterns: classes are upper bounds of lengths, in steps of capacity / CLASSES.
    step = -(-capacity // CLASSES)
    top = capacity // step
    weight = np.zeros(top + 1)
    for n, c in left.items():
        weight[min(-(-n // step), top)] += c
    known = [p for p in patterns(top) if all(weight[c] for c in p)]
    if known:
        matrix = np.zeros((top, len(known)))
        for j, p in enumerate(known):
            for c in p:
                matrix[c - 1, j] += 1
        # Short lengths are easy to place later: long ones weigh more in the fit.
        importance = np.arange(1, top + 1) / top
        repeats = np.floor(nnls(matrix * importance[:, None], weight[1:] * importance) * share).astype(int)
        lengths = sorted(left)
        stock = {c: sorted((n for n in left if -(-n // step) == c), reverse=True) for c in range(1, top + 1)}
        for j in np.argsort(-repeats, kind="stable").tolist():
            want = int(repeats[j])
            while want > 0:
                # Lengths that this stretch of repeats takes, the longest there are of each class; the last fits the room that is left best.
                need: dict[int, int] = {}
                room = capacity
                for c in known[j][:-1]:
                    n = next((n for n in stock[c] if left.get(n, 0) > need.get(n, 0)), None)
                    if n is None:
                        break
                    need[n] = need.get(n, 0) + 1
                    room -= n
                else:
                    at = bisect.bisect_right(lengths, room) - 1
                    while at >= 0 and left.get(lengths[at], 0) <= need.get(lengths[at], 0):
                        at -= 1
                    if at >= 0:
                        need[lengths[at]] = need.get(lengths[at], 0) + 1
                if sum(need.values()) < len(known[j]):
                    break
                run = min(want, *(left[n] // k for n, k in need.items()))
                room = capacity
                for n, k in sorted(need.items(), reverse=True):
                    for _ in range(k):
                        place(n, total, run, room)
                        room -= n
                add_room(room, total, total + run)
                total += run
                want -= run
    # Residuals, longest first, each into the least room that is enough.
    for length in sorted(left, reverse=True):
        while length in left:
            at = bisect.bisect_left(free, length)
            if at == len(free):  # new sequences, as many of this length in each as fit
                each = capacity // length
                count = -(-left[length] // each)
                room, begin = capacity, total
                total += count
                for _ in range(each):
                    now = min(count, left.get(length, 0))
                    if not now:
                        break
                    place(length, begin, now, room)
                    if now < count:
                        add_room(room, begin + now, begin + count)
                        count = now
                    room -= length
                add_room(room, begin, begin + count)
                continue
            room = free[at]
            first, end = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                free.pop(at)
            count = min(end - first, left[length])
            place(length, first, count, room)
            add_room(room - length, first, first + count)
            add_room(room, first + count, end)
    return rows, total


# The characters that byte-level vocabularies write for bytes; printable ones stand for themselves, the others follow from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}
#: Letters that the normalizer leaves as they are: such a piece is one run of letters for the tokenizer.
_SETTLED = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


@functools.cache
def _worker(vocabulary: str):
    """The tokenizer, for as long as a Python worker lives; what it has tokenized goes with the task."""
    return _encoder(vocabulary)


def _encoder(vocabulary: str):
    """Ids of pieces without white space: runs of settled letters by the model itself, others through the whole tokenizer."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    model = tokenizer.model

    def encode(pieces: list[bytes]) -> list[np.ndarray]:
        out = []
        for piece in pieces:
            text = piece.decode("utf-8", "replace")
            if _SETTLED.fullmatch(text):
                ids = [t.id for t in model.tokenize(text if len(text) == len(piece) else piece.decode("latin-1").translate(_BYTE_CHARS))]
            else:
                ids = tokenizer.encode(text, add_special_tokens=False).ids
            out.append(np.array(ids, np.uint32))
        return out

    return tokenizer, encode


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PLAIN = np.zeros(256, bool)  # ASCII marks that start no contraction and end no word
_PLAIN[[c for c in range(0x21, 0x7F) if not (chr(c).isalnum() or c == 0x27)]] = True


def _piece_bounds(block: kernel.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut where an ASCII letter meets an ASCII mark other than the apostrophe: no token spans such a place."""
    letter, plain = _LETTER[block.buf], _PLAIN[block.buf]
    cut = np.flatnonzero((letter[:-1] & plain[1:]) | (plain[:-1] & letter[1:])) + 1
    solid = np.ones(len(block.buf) + 1, bool)
    solid[block.offs] = False  # a document's first byte belongs to no earlier word
    cut = cut[solid[cut]]
    start, end = (np.sort(np.concatenate((edge, cut[~np.isin(cut, edge, assume_unique=True)]))) for edge in (block.start, block.end))
    return start, end, np.searchsorted(start, block.offs)


def _lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased where the next byte is ASCII too (no mark can combine with the letter), as the normalizer does."""
    upper = (buf >= 0x41) & (buf <= 0x5A)
    upper[:-1] &= buf[1:] < 0x80
    return buf + upper.astype(np.uint8) * np.uint8(0x20)


def _token_pieces(vocabulary: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, encode = _worker(vocabulary)
        known = PieceIds(encode, most=400_000)
        specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        for batch in batches:
            for block in kernel.blocks(batch.column(1)):
                start, end, offs = _piece_bounds(block)
                ids, size = known.lookup(_lowered(block.buf), start, end)
                cut = np.concatenate(([0], np.cumsum(kernel.fold(size, offs))))
                data = block.buf.tobytes()
                special = any(s.encode() in data for s in specials)
                rows: list[list[int]] = [[], [], [], [], []]
                for i in range(block.n):
                    own = ids[cut[i] : cut[i + 1]]
                    if special and any(s.encode() in data[block.offs[i] : block.offs[i + 1]] for s in specials):
                        own = np.array(tokenizer.encode(block.text(block.offs[i], block.offs[i + 1]), add_special_tokens=False).ids, np.uint32)
                    own = np.append(own, np.uint32(end_id)).astype("<u4")
                    for piece, at in enumerate(range(0, len(own), length)):
                        part = own[at : at + length]
                        for column, value in zip(rows, (i, piece, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                            column.append(value)
                docs = batch.column(0).slice(block.first, block.n).take(pa.array(rows[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([docs, pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", length: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of tokenized documents with their sequence and place in it.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A
    document is its ids and ``end_id``; only documents longer than ``length`` are
    cut.  A null text is an empty one (one piece of one id).  Every row is
    packed, repeated ones and null ids too; lengths tie in any order.  Other
    columns, whatever their names, are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = base.mapInArrow(kernel.lean(_token_pieces(vocabulary, length, end_id)), "doc_id long, piece int, start long, length long, ids_crc32 long")
    # Ranks inside a length come in two steps, so that no length meets in one task: lots first, then places in a lot.
    pieces = scratch.table(pieces.withColumn("lot", F.spark_partition_id()))
    counts = pieces.groupBy("length", "lot").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # one row per length, at most ``length``
    rows, _ = plan_packing(histogram, length)
    return _assign(pieces, counts, rows, scratch)


def _assign(pieces: DataFrame, counts: DataFrame, rows: list[tuple[int, int, int, int, int]], scratch: Scratch) -> DataFrame:
    """Joins pieces to the plan: (length, lot) gives the first rank, a counter inside the task the rest."""
    from pyspark.sql import Window

    spark = pieces.sparkSession
    before = counts.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "lot", F.coalesce("base", F.lit(0)).alias("base"))
    plan = spark.sparkContext.broadcast(_Plan(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        used: dict[tuple[int, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            size, lot, base = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5, 6))
            order = np.lexsort((size, lot))
            a, b = size[order], lot[order]
            head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            count = np.diff(np.concatenate((head, [len(a)])))
            rank = np.empty(len(a), np.int64)
            for h, c in zip(head.tolist(), count.tolist(), strict=True):
                key = (int(b[h]), int(a[h]))
                first = used.get(key, 0)
                used[key] = first + c
                rank[order[h : h + c]] = np.arange(first, first + c)
            sequence, offset = p.find(size, base + rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    joined = pieces.join(before, ["length", "lot"]).select("doc_id", "piece", "start", "length", "ids_crc32", "lot", "base")
    # All of a lot's pieces of one length must meet one counter.
    joined = joined.repartition(partitions(spark), "length", "lot")
    return joined.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


class _Plan:
    """The plan's rows by (length, rank), for bisection."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.lengths, begin = np.unique(table[:, 0], return_index=True)
        self.parts = [p for p in np.split(table, begin[1:])]

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        for n in np.unique(size).tolist():
            part = self.parts[int(np.searchsorted(self.lengths, n))]
            at = np.flatnonzero(size == n)
            row = part[np.searchsorted(part[:, 1], rank[at], "right") - 1]
            sequence[at] = row[:, 3] + rank[at] - row[:, 1]
            offset[at] = row[:, 4]
        return sequence, offset
