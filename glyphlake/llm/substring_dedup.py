"""Substring dedup: FM-indexes of word sequences, sharded by content.

A window is ``window`` consecutive words of a document; a word is removed if a
window over it also starts in a document with a smaller id.

Shards are cut by content, not by document, so that a window is looked up in
one shard only.  A window's key is the least hash of the five-word grams in it
(a minimizer), and a document's stretches of windows with one key travel whole,
as fragments:

1. keys that occur in one document only are dropped (a membership filter of
   fixed size holds the others; strangers it lets through cost work only);
2. fragments are dealt out by key, equal ones of a stretch of text once, with
   their smallest and largest document.  Keys with more than HOT fragments send
   single windows, dealt out by the window itself, so no shard gets them all;
3. each shard builds an FM-index of its distinct fragments (a suffix array
   sorted as deep as a window, the Burrows-Wheeler transform in a wavelet matrix
   of packed bits with block ranks) and runs the fragments' windows through it by
   backward search, all at once; a window leaves the search when only its own
   place matches.  The matched intervals give the smallest document of each;
4. the answers are joined to the places of the fragments that have one (found by
   a second pass over the text, which costs less than keeping all places), and
   documents with a removed word are cut.

Words and grams are compared by 64-bit hashes, a window by those of all its
words; fragments by their hash and their key together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .scratch import Members, Scratch, members, partitions

GRAM = 5
#: Bytes of text whose keys and fragments are merged before they are sent.
STRETCH = 8 << 20
#: Fragments of one key that may meet in one shard.
HOT = 10_000


def _runs(block: kernel.Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and of each stretch of windows with one key: first word, windows, key, document."""
    words = kernel.word_hashes(block)
    starts, count = kernel.gram_starts(block.word_offs, window)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return words, none, none, none.astype(np.uint64), none
    key, have, width = kernel.gram_hashes(words, GRAM), 1, window - GRAM + 1
    while have < width:  # sliding minimum by doubling
        step = min(have, width - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    key = key[starts]
    doc = np.repeat(np.arange(block.n), count)
    head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))))
    return words, starts[head], np.diff(np.concatenate((head, [len(key)]))), key[head], doc[head]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(40)).astype(np.int64) * buckets) >> 24


def _stretches(batches: Iterator[pa.RecordBatch], of) -> Iterator[list]:
    """What ``of`` makes of each block, gathered over about STRETCH bytes; columns are (id, tag, text)."""
    held, size = [], 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        tags = batch.column(1).to_numpy(zero_copy_only=False)
        for block in kernel.blocks(batch.column(2)):
            rows = slice(block.first, block.first + block.n)
            held.append(of(block, ids[rows], tags[rows]))
            size += len(block.buf)
            if size >= STRETCH:
                yield held
                held, size = [], 0
    if held:
        yield held


_MANY = np.int64(-(2**63))  # stands for several documents


def _keys(window: int, buckets: int):
    def of(block, ids, tags):
        _, _, _, key, doc = _runs(block, window)
        return key, ids[doc]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _stretches(batches, of):
            key, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            if not len(key):
                continue
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            tail = np.concatenate((head[1:], [len(key)])) - 1
            only = np.where(doc[head] == doc[tail], doc[head], _MANY)
            key, size = key[head], (tail - head + 1).astype(np.int32)
            cut = np.searchsorted(_bucket(key, buckets), np.arange(buckets + 1))
            full = [b for b in range(buckets) if cut[b] < cut[b + 1]]
            part = lambda x: pa.array([x[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), part(key), part(only), part(size)], ["bucket", "keys", "docs", "sizes"])

    return run


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket after another -> keys of more than one document, with their number of fragments."""
    for rows in kernel.by_first(batches):
        key, doc, size = (np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in enumerate((np.uint64, np.int64, np.int32)))
        order = np.argsort(key, kind="stable")
        key, doc, size = key[order], doc[order], size[order]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        low, high = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)
        total = np.add.reduceat(size.astype(np.int64), head)
        many = (low != high) | (low == _MANY)
        yield pa.RecordBatch.from_arrays([pa.array(key[head][many].view(np.int64)), pa.array(total[many])], ["key", "fragments"])


def _sequence_hashes(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    up, down = kernel._power_tables(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return kernel.mix((total[start + size] - total[start]) * down[start] + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


class _Fragments:
    """The fragments of a block: first word and words, hash, key, whether of a hot key, and document."""

    def __init__(self, block: kernel.Block, window: int, shared: Members, hot: Members):
        self.words, start, count, key, doc = _runs(block, window)
        keep = np.flatnonzero(shared.has(key))
        start, count, key, doc = start[keep], count[keep], key[keep], doc[keep]
        single = hot.has(key)
        times = np.where(single, count, 1)
        each = np.repeat(np.arange(len(start)), times)
        self.start = kernel.ragged(start, times)
        self.size = np.where(single, 1, count)[each] + window - 1
        self.frag = _sequence_hashes(self.words, self.start, self.size)
        self.key, self.single, self.doc = key[each], single[each], doc[each]


def _places(window: int, shared, hot, wanted):
    """(frag, key, doc_id, tag, place) of the fragments that may have an answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in kernel.blocks(batch.column(2)):
                f = _Fragments(block, window, shared.value, hot.value)
                some = np.flatnonzero(wanted.value.has(f.frag))
                doc = f.doc[some]
                rows = pa.array(doc + block.first)
                place = (f.start[some] - block.word_offs[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(f.frag[some].view(np.int64)), pa.array(f.key[some].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place)], ["frag", "key", "doc_id", "tag", "place"])

    return run


def _contents(window: int, shared, hot, buckets: int):
    """Distinct fragments of each stretch of text for the shards, by bucket."""

    def of(block, ids, tags):
        f = _Fragments(block, window, shared.value, hot.value)
        owner = ids[f.doc]
        once, low, high = _distinct(f.frag, f.key, owner, owner)
        bucket = _bucket(np.where(f.single[once], f.frag[once], f.key[once]), buckets)
        return f.frag[once], f.key[once], low, high, f.size[once], bucket, f.words[kernel.ragged(f.start[once], f.size[once])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _stretches(batches, of):
            frag, key, low, high, size, bucket, words = (np.concatenate(x) for x in zip(*held, strict=True))
            if not len(frag):
                continue
            once, low, high = _distinct(frag, key, low, high)
            order = np.argsort(bucket[once], kind="stable")
            once, low, high = once[order], low[order], high[order]
            offs = np.concatenate(([0], np.cumsum(size)))
            cut = np.searchsorted(bucket[once], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cut)).tolist()
            part = lambda x: pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary())
            own = [once[cut[i] : cut[i + 1]] for i in full]
            contents = pa.array([words[kernel.ragged(offs[o], size[o])].tobytes() for o in own], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), part(frag[once]), part(key[once]), part(low), part(high), part(size[once].astype(np.int32)), contents], ["bucket", "frags", "keys", "lows", "highs", "sizes", "words"])

    return run


def _distinct(frag: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the first of each distinct (fragment, key), with the smallest low and largest high of its equals."""
    if not len(frag):
        return np.zeros(0, np.int64), low, high
    order = np.lexsort((key, frag))
    ranked, by = frag[order], key[order]
    head = np.flatnonzero(np.concatenate(([True], (ranked[1:] != ranked[:-1]) | (by[1:] != by[:-1]))))
    return order[head], np.minimum.reduceat(low[order], head), np.maximum.reduceat(high[order], head)


class FmIndex:
    """FM-index of a code sequence (0 separates) for patterns of up to ``depth`` codes.

    The suffix array is sorted by the first ``depth`` codes at least, which is
    all that intervals of such patterns need.  It goes when the transform is
    made; what stays beside the wavelet matrix is ``values``, given for each
    place of the sequence, in the order of the suffixes.
    """

    def __init__(self, codes: np.ndarray, depth: int, values: np.ndarray):
        n = len(codes)
        suffixes = self._sort(codes, depth)
        self.values = values[suffixes]
        bwt = codes[suffixes - 1]
        del suffixes
        sigma = int(codes.max()) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=sigma))))
        self.levels = []
        for bit in range(max(sigma - 1, 1).bit_length() - 1, -1, -1):
            one = (bwt >> bit & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, bool)
            padded[:n] = one
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]))
            self.levels.append((bit, packed, ranks, n - int(one.sum())))
            bwt = np.concatenate((bwt[~one], bwt[one]))
        symbols = np.arange(sigma)
        self.shift = self.before[:-1] - self._descend(symbols, np.zeros(sigma, np.int64))

    @staticmethod
    def _sort(codes: np.ndarray, depth: int) -> np.ndarray:
        n = len(codes)
        order = np.argsort(codes, kind="stable")
        span, rank = 1, codes
        while True:
            ranked = rank[order] if span == 1 else ranked_keys
            head = np.concatenate(([True], ranked[1:] != ranked[:-1]))
            if span >= depth or head.all():
                return order
            place = np.empty(n, np.int64)
            place[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
            ahead = np.zeros(n, np.int64)
            ahead[: n - span] = place[span:] + 1
            key = place * (n + 1) + ahead
            order = np.argsort(key, kind="stable")
            ranked_keys = key[order]
            rank = place
            span *= 2

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, packed, ranks, zeros in self.levels:
            block, inside = at >> 6, (at & 63).astype(np.uint64)
            ones = ranks[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << inside) - np.uint64(1)))
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Interval bounds after putting ``symbol`` before the pattern."""
        return self.shift[symbol] + self._descend(symbol, at)


def window_owners(codes: np.ndarray, sizes: np.ndarray, lows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each fragment's windows in turn: the smallest document of all fragments that hold it; and the offsets."""
    offs = np.concatenate(([0], np.cumsum(sizes)))
    _, code = np.unique(codes, return_inverse=True)
    n_fragments = len(sizes)
    text = np.zeros(len(code) + n_fragments, np.int64)
    where = np.arange(len(code)) + np.repeat(np.arange(n_fragments), sizes)
    text[where] = code + 1
    docs, owner_code = np.unique(lows, return_inverse=True)  # codes in the order of ids
    index = FmIndex(text, window, np.repeat(owner_code.astype(np.int32), sizes + 1))
    count = sizes - window + 1
    start = kernel.ragged(offs[:-1] + np.arange(n_fragments), count)
    owner = np.repeat(lows, count)
    active = np.arange(len(start))
    symbol = text[start + window - 1]
    lo, hi = index.before[symbol], index.before[symbol + 1]
    for back in range(2, window + 1):
        more = np.flatnonzero(hi - lo > 1)
        active, lo, hi = active[more], lo[more], hi[more]
        if not len(active):
            break
        symbol = text[start[active] + window - back]
        both = index.step(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        lo, hi = both[: len(lo)], both[len(lo) :]
    more = np.flatnonzero(hi - lo > 1)
    active, lo, hi = active[more], lo[more], hi[more]
    if len(active):
        first, at = np.unique(lo, return_index=True)
        ends = np.stack([first, hi[at]], 1).ravel()
        least = docs[np.minimum.reduceat(np.append(index.values, len(docs) - 1), ends)[::2]]
        owner[active] = least[np.searchsorted(first, lo)]
    return owner, np.concatenate(([0], np.cumsum(count)))


def _shards(window: int):
    """Rows of one bucket after another -> (frag, key, owners) where some document of the fragment isn't the first."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        frag, key, low, high, size, words = (np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in enumerate((np.uint64, np.uint64, np.int64, np.int64, np.int32, np.uint64)))
        size = size.astype(np.int64)
        offs = np.concatenate(([0], np.cumsum(size)))
        once, low, high = _distinct(frag, key, low, high)
        owner, cut = window_owners(words[kernel.ragged(offs[once], size[once])], size[once], low, window)
        if not len(owner):
            return
        later = np.flatnonzero(np.minimum.reduceat(owner, cut[:-1]) < high)
        for at in range(0, len(later), 8192):
            part = later[at : at + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(frag[once][part].view(np.int64)), pa.array(key[once][part].view(np.int64)), pa.array([owner[cut[i] : cut[i + 1]].tobytes() for i in part], pa.binary())], ["frag", "key", "owners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in kernel.by_first(batches):
            yield from solve(rows)

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, place, owners) -> starts of the windows whose owner is a smaller document."""
    for batch in batches:
        doc, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        owners = batch.column(3).to_pylist()
        count = np.array([len(o) // 8 for o in owners], np.int64)
        owner = np.frombuffer(b"".join(owners), np.int64)
        hit = owner < np.repeat(doc, count)
        start = kernel.ragged(place.astype(np.int64), count)[hit].astype(np.int32)
        cut = np.concatenate(([0], np.cumsum(kernel.fold(hit.astype(np.int64), np.concatenate(([0], np.cumsum(count)))))))
        some = np.flatnonzero(np.diff(cut))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)), pa.array([start[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())], ["doc_id", "tag", "starts"])


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _finish(window: int, with_text: bool):
    """(doc_id, text, starts, row) -> (doc_id, n_words, n_removed, kept_sha256, kept_text, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, gone, sha, kept = [], [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = (text or "").encode().split()  # splits at the six separators exactly
                removed = 0
                if starts:
                    mark = np.zeros(len(parts) + 1, np.int64)
                    for s in starts:
                        at = np.frombuffer(s, np.int32)
                        np.add.at(mark, at, 1)
                        np.add.at(mark, at + window, -1)
                    stay = np.cumsum(mark)[:-1] == 0
                    removed = len(parts) - int(stay.sum())
                    left = [p for p, s in zip(parts, stay.tolist(), strict=True) if s]
                else:
                    left = parts
                joined = b" ".join(left)
                words.append(len(parts))
                gone.append(removed)
                sha.append(_sha(joined))
                kept.append((joined.decode() if removed else text) if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), batch.column(3)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "row"])

    return run


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, with_rows: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text, row) for every row of docs.

    kept_text and row are filled with_rows only: the kept words joined by one
    space (the text itself where nothing was removed), and the input row's other
    columns as a struct.  A null or wordless text has no windows.  Rows with a null id take no
    part and keep all words.  Rows that share an id are one document for the
    comparison of ids: they never remove words of each other; repeated rows are
    cut alike.  Very long texts are searched whole.  Columns of docs may have any
    names; an empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    n = partitions(spark)
    buckets = 8 * n
    row = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != text_col)) if with_rows else F.lit(None).cast("int")
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"), row.alias("row"))
    texts = base.where("doc_id is not null").select("doc_id", "tag", "text")
    sent = texts.mapInArrow(kernel.lean(_keys(window, buckets)), "bucket int, keys binary, docs binary, sizes binary")
    keys = scratch.table(sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(kernel.lean(_shared_keys), "key long, fragments long"))
    del sent
    scratch.release()
    shared = spark.sparkContext.broadcast(members(keys, "key"))
    hot = spark.sparkContext.broadcast(members(keys.where(F.col("fragments") > HOT), "key"))
    sent = texts.mapInArrow(kernel.lean(_contents(window, shared, hot, buckets)), "bucket int, frags binary, keys binary, lows binary, highs binary, sizes binary, words binary")
    shards = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(kernel.lean(_shards(window)), "frag long, key long, owners binary")
    owners = scratch.table(shards)
    del sent, shards
    scratch.release()
    wanted = spark.sparkContext.broadcast(members(owners, "frag"))
    places = texts.mapInArrow(kernel.lean(_places(window, shared, hot, wanted)), "frag long, key long, doc_id long, tag long, place int")
    found = places.join(owners, ["frag", "key"]).select("doc_id", "tag", "place", "owners").mapInArrow(kernel.lean(_removed), "doc_id long, tag long, starts binary")
    spans = scratch.table(found.groupBy("doc_id", "tag").agg(F.collect_list("starts").alias("starts")))
    del found, places
    scratch.drop(owners, keys)
    scratch.release()
    if spans.isEmpty():
        joined = base.withColumn("starts", F.lit(None).cast("array<binary>"))
    else:
        joined = base.join(spans, ["doc_id", "tag"], "left")
    row_type = base.schema["row"].dataType.simpleString()
    return joined.select("doc_id", "text", "starts", "row").mapInArrow(kernel.lean(_finish(window, with_rows)), f"doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, row {row_type}")
