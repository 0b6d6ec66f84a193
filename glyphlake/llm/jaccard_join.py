"""N-gram Jaccard join: near-duplicate groups by set-relation skipping.

Documents are sets of k-word shingles (64-bit hashes).  Equal sets are one set
from the start (the closest set relation).  For the rest:

1. Shingles stand in one global order, the rarer first.  How often one occurs
   is read from a table of CELLS counters that all documents fill, by hash; it
   may only be too high.  Any order is correct; this one keeps passages and
   phrases that many documents hold out of the prefixes, however large the table
   is, so posting lists stay short.
2. Two sets of similarity t share c shingles (or all of a smaller
   intersection) among the first n - ceil(t n) + c of each.  Only those postings
   are dealt out, as columnar blocks by shingle range; equal sets of a block
   send one posting.
3. In short posting lists the pairs that length and position allow are counted;
   a pair is an edge if what its prefixes share, with all that may follow, is
   enough.  The members of a long list are connected unless
   its length and position bounds rule every pair of a block out (index-level
   skipping).  Connected sets are a candidate group; its sets meet in one task.
4. Inside a group an inverted index with lists in size order is searched:
   blocks of a list are skipped by size and position, sets already known to be
   in the same component are skipped, and an overlap bound is derived from the
   answers of a highly similar set that was computed before (answer-level
   skipping); what remains is verified exactly.
5. A group too large for one task is cut into blocks by set size, and pairs of
   blocks whose sizes fit are searched the same way, each in its own task.

Shingles are compared by 64-bit hashes of their words.  Sets are named by a
64-bit fingerprint of their shingles and checked by a second one: if two sets of
one name differ in the second, everything is done again with other fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .components import connected_components
from .scratch import Members, Scratch, members, partitions

#: Bytes of text whose sets are counted and sent together.
WINDOW = 8 << 20
#: Counters of shingles (one byte each when they are sent out), a power of two, and the slices that they are added up in.
CELLS, SLICES = 1 << 24, 64
#: Shingle hashes that one task searches at once; larger groups are cut.
GROUP_HASHES = 6 << 20
#: Shared prefix shingles that make a pair a candidate.
SHARED = 4
#: Stands for enough shared shingles.
_CONNECTED = 1 << 40
#: Postings compared as one block within a list; longer lists are connected by blocks.
LIST_BLOCK = 128
#: Postings that one bucket of shingles holds on average, at most.
BUCKET_POSTINGS = 1 << 18


def _required(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of sets of n and m members with 100 * inter >= percent * union."""
    return -((-percent * (n + m)) // (100 + percent))


def _prefix(n: np.ndarray, percent: int, shared: int = 1) -> np.ndarray:
    return np.minimum(n, n - (-((-percent * n) // 100)) + shared)


def set_ids(values: np.ndarray, offs: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit fingerprints of sets; those of different seeds are independent."""
    salt = kernel.mix(np.array([seed], np.uint64))[0]
    one = kernel.fold(kernel.mix(values ^ np.uint64(0x5851F42D4C957F2D) ^ salt), offs)
    two = kernel.fold(kernel.mix(values + (np.uint64(0x14057B7EF767814F) ^ salt)), offs)
    return kernel.mix(one ^ kernel.mix(two + np.diff(offs).astype(np.uint64)))


def _windows(batches: Iterator[pa.RecordBatch], k: int, texts: int, seed: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows' batch columns, values, offsets, set ids) of stretches of about WINDOW bytes."""
    held, size = [], 0
    for batch in batches:
        for block in kernel.blocks(batch.column(texts), lower=True):
            held.append((batch.slice(block.first, block.n), *kernel.shingle_sets(block, k)))
            size += len(block.buf)
            if size >= WINDOW:
                yield _joined(held, seed)
                held, size = [], 0
    if held:
        yield _joined(held, seed)


def _joined(held: list, seed: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    values = np.concatenate([h[1] for h in held])
    offs = np.cumsum(np.concatenate([[0], *(np.diff(h[2]) for h in held)]))
    return [h[0] for h in held], values, offs, set_ids(values, offs, 2 * seed)


def _distinct(values: np.ndarray, offs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One of each set, without empty ones."""
    size = np.diff(offs)
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first[size[first] > 0])
    picked = kernel.ragged(offs[first], size[first])
    return values[picked], np.concatenate(([0], np.cumsum(size[first]))), ids[first]


_DESCRIBED = ["doc_id", "tag", "n_shingles", "id", "proof", "slice", "counters"]


def _cells(values: np.ndarray) -> np.ndarray:
    """The counter of each shingle."""
    return (values >> np.uint64(65 - CELLS.bit_length())).astype(np.uint32)


def _describe(k: int, seed: int):
    """A row for each document, and then one for each slice of the counters of the task's sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = None
        for rows, values, offs, ids in _windows(batches, k, 2, seed):
            docs, tags = (pa.concat_arrays([r.column(i) for r in rows]) for i in (0, 1))
            n = len(docs)
            checks = set_ids(values, offs, 2 * seed + 1)
            if counters is None:
                counters = np.zeros(CELLS, np.uint16)
            cells = np.sort(_cells(_distinct(values, offs, ids)[0]))
            first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))[: len(cells)])
            cells, count = cells[first], np.diff(np.concatenate((first, [len(cells)])))
            counters[cells] = np.minimum(counters[cells] + count, 0xFFFF)
            columns = [docs, tags, pa.array(np.diff(offs)), pa.array(ids.view(np.int64)), pa.array(checks.view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, _DESCRIBED)
        if counters is not None:
            data = {i: part for i, part in enumerate(counters.reshape(SLICES, -1)) if part.any()}
            packed = pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True) for part in data.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(data), pa.int64()) for _ in range(5)), pa.array(list(data), pa.int32()), packed], _DESCRIBED)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, packed counters) -> (slice, twelve times the logarithm to base 2 of its sums, as bytes)."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at in range(batch.num_rows):
            i, part = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
            own = total.setdefault(i, np.zeros(CELLS // SLICES, np.uint32))
            own += np.frombuffer(pa.decompress(part, CELLS // SLICES * 2, "zstd", asbytes=True), np.uint16)
    if total:
        levels = [np.minimum(12 * np.log2(1 + own.astype(np.float32)), 255).astype(np.uint8).tobytes() for own in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], ["slice", "levels"])


def _frequencies(described: DataFrame) -> np.ndarray:
    """How frequent the shingles of each counter are: CELLS bytes."""
    n = min(SLICES, partitions(described.sparkSession))
    rows = described.where("slice is not null").select("slice", "counters").repartition(n, "slice").mapInArrow(kernel.lean(_added), "slice int, levels binary").collect()
    out = np.zeros((SLICES, CELLS // SLICES), np.uint8)
    for row in rows:
        out[row.slice] = np.frombuffer(row.levels, np.uint8)
    return out.ravel()


def _in_order(values: np.ndarray, offs: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Indices of values by document and global order: the rare first, those of one level by hash (as they come)."""
    return np.lexsort((level[_cells(values)], np.repeat(np.arange(len(offs) - 1), np.diff(offs))))


def _post(k: int, percent: int, frequencies, buckets: int, seed: int):
    """Columnar blocks of postings by shingle range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = frequencies.value
        for _, values, offs, ids in _windows(batches, k, 0, seed):
            values, offs, ids = _distinct(values, offs, ids)
            size = np.diff(offs)
            values = values[_in_order(values, offs, level)]
            length = _prefix(size, percent, SHARED)
            token = values[kernel.ragged(offs[:-1], length)]
            owner = np.repeat(np.arange(len(ids), dtype=np.uint32), length)
            place = kernel.ragged(np.zeros(len(ids), np.int64), length).astype(np.uint32)
            bucket = ((token >> np.uint64(40)).astype(np.int64) * buckets) >> 24
            order = np.argsort(bucket, kind="stable")
            token, owner, place, bucket = token[order], owner[order], place[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            full = [b for b in range(buckets) if cut[b] < cut[b + 1]]
            for at in range(0, len(full), 256):
                part, data = full[at : at + 256], []
                for b in part:
                    s = slice(cut[b], cut[b + 1])
                    used, local = np.unique(owner[s], return_inverse=True)
                    data.append([token[s].tobytes(), local.astype(np.uint32).tobytes(), place[s].tobytes(), ids[used].tobytes(), size[used].tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*data, strict=True))], ["bucket", "token", "owner", "place", "ids", "sizes"])

    return run


def _lists(percent: int):
    """Rows of one bucket after another -> edges that connect every pair of sets which a posting list leaves possible."""

    def solve(rows: list[list[bytes]]) -> pa.RecordBatch | None:
        owner = [np.frombuffer(r[1], np.uint32) for r in rows]
        token = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
        ids = np.concatenate([np.frombuffer(r[3], np.uint64)[own] for r, own in zip(rows, owner, strict=True)])
        size = np.concatenate([np.frombuffer(r[4], np.int64)[own] for r, own in zip(rows, owner, strict=True)])
        place = np.concatenate([np.frombuffer(r[2], np.uint32).astype(np.int64) for r in rows])
        _, run_of, run_size = np.unique(token, return_inverse=True, return_counts=True)
        keep = np.flatnonzero(run_size[run_of] > 1)
        order = keep[np.lexsort((ids[keep], size[keep], token[keep]))]
        token, ids, size, place = token[order], ids[order], size[order], place[order]
        again = np.zeros(len(ids), bool)
        again[1:] = (token[1:] == token[:-1]) & (ids[1:] == ids[:-1])  # one set from several blocks
        token, ids, size, place = token[~again], ids[~again], size[~again], place[~again]
        if not len(token):
            return None
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        length = np.diff(np.concatenate((start, [len(token)])))
        counted: list[tuple[np.ndarray, ...]] = []
        for n in np.unique(length[(length > 1) & (length <= LIST_BLOCK)]).tolist():
            i, j = np.triu_indices(n, 1)
            at = start[length == n]
            for part in np.array_split(at, 1 + len(at) * len(i) // 2_000_000):
                left, right = _possible(size, place, (part[:, None] + i).ravel(), (part[:, None] + j).ravel(), percent)
                counted.append(_count_pairs(ids[left], ids[right], np.ones(len(left), np.int64), size[left], size[right], percent))
        for s, n in zip(start[length > LIST_BLOCK].tolist(), length[length > LIST_BLOCK].tolist(), strict=True):
            left, right = _list_edges(size[s : s + n], place[s : s + n], percent)
            counted.append(_count_pairs(ids[s + left], ids[s + right], np.full(len(left), _CONNECTED), size[s + left], size[s + right], percent))
        if not counted:
            return None
        low, high, times, need = _merge_pairs(*(np.concatenate(c) for c in zip(*counted, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array(times), pa.array(need)], ["a", "b", "times", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in kernel.by_first(batches):
            if out := solve(rows):
                yield out

    return run


def _count_pairs(a: np.ndarray, b: np.ndarray, times: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """(low id, high id, shared prefix shingles, how many of them make an edge) of each pair once.

    Of the two prefixes one ends first; all shared shingles up to there are in
    both, so at most the rest of that set can be shared besides.
    """
    floor = np.minimum(SHARED, -((-percent * np.maximum(n, m)) // 100))
    rest = np.maximum(n - _prefix(n, percent, SHARED), m - _prefix(m, percent, SHARED))
    need = np.maximum(floor, _required(n, m, percent) - rest)
    return _merge_pairs(np.minimum(a, b), np.maximum(a, b), times, need)


def _merge_pairs(low: np.ndarray, high: np.ndarray, times: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    head = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))[: len(low)])
    total = np.add.reduceat(times[order], head) if len(head) else times
    return low[head], high[head], total, need[order][head]


def _possible(size: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that can be similar: what may be shared before this shingle, and from it on."""
    most = np.minimum(place[i], place[j]) + np.minimum(size[i] - place[i], size[j] - place[j])
    ok = (most >= _required(size[i], size[j], percent)) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
    return i[ok], j[ok]


def _list_edges(size: np.ndarray, place: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same connected components as all possible pairs of a list in size order.

    A block is compared with the blocks after it until sizes are too far apart;
    a pair of blocks is skipped if its best sizes and places rule all its pairs
    out, and a set that is joined already is compared no more than once a block.
    """
    n = len(size)
    a, b = [], []
    root = np.arange(n)
    for s in range(0, n, LIST_BLOCK):
        e = min(s + LIST_BLOCK, n)
        for t in range(s, n, LIST_BLOCK):
            u = min(t + LIST_BLOCK, n)
            if 100 * size[e - 1] < percent * size[t]:
                break
            rest = min((size[s:e] - place[s:e]).max(), (size[t:u] - place[t:u]).max()) + min(place[s:e].max(), place[t:u].max())
            if rest < _required(size[s], size[t], percent):
                continue
            if (root[s:e] == root[s]).all() and (root[t:u] == root[s]).all():
                continue
            i, j = (x.ravel() for x in np.meshgrid(np.arange(s, e), np.arange(t, u), indexing="ij"))
            i, j = i[(i < j) & (root[i] != root[j])], j[(i < j) & (root[i] != root[j])]
            i, j = _possible(size, place, i, j, percent)
            while len(i):  # a spanning forest of these pairs: few passes, as each joins all roots that it can
                low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
                _, first = np.unique(high, return_index=True)
                a.append(i[first])
                b.append(j[first])
                to = np.arange(n)
                to[high[first]] = low[first]
                while (to[to] != to).any():
                    to = to[to]
                root = to[root]
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def search_group(sets: list[np.ndarray], percent: int, sides: list[int] | None = None, links: list[tuple[int, int]] | None = None) -> np.ndarray:
    """Component (smallest index) of each set under links of at least percent.

    sets are distinct-valued hash arrays.  With sides (0 or 1 for each set),
    only links between the two sides count.  With a list for links, every
    candidate pair is decided, those inside a component too, and the linked ones
    (indices) are added to it.
    """
    n = len(sets)
    given = np.argsort([len(s) for s in sets], kind="stable")  # sets are handled in order of size
    size = np.array([len(sets[i]) for i in given])
    side = None if sides is None else np.array(sides)[given]
    _, code, df = np.unique(np.concatenate([sets[i] for i in given]), return_inverse=True, return_counts=True)
    rarest = np.argsort(df, kind="stable")
    rank = np.empty(len(df), np.int64)
    rank[rarest] = np.arange(len(df))
    df = df[rarest]
    offs = np.concatenate(([0], np.cumsum(size)))
    coded = [np.sort(rank[code[offs[i] : offs[i + 1]]]) for i in range(n)]
    # The index: postings of the prefixes, by shingle and then by size of set.
    length = _prefix(size, percent)
    token = np.concatenate([c[:p] for c, p in zip(coded, length, strict=True)])
    owner = np.repeat(np.arange(n), length)
    place = kernel.ragged(np.zeros(n, np.int64), length)
    shared = df[token] > 1
    token, owner, place = token[shared], owner[shared], place[shared]
    order = np.lexsort((owner, token))
    token, owner, place = token[order], owner[order], place[order]
    begin = np.searchsorted(token, token)  # where each posting's list begins
    by_owner = np.argsort(owner, kind="stable")
    own_offs = np.searchsorted(owner[by_owner], np.arange(n + 1))
    sizes, rest = size[owner], size[owner] - place
    root = np.arange(n)
    answers: list[dict[int, int]] = []  # of each set: bounds of overlaps with sets it isn't linked to
    for x in range(n):
        least, found = -((-percent * size[x]) // 100), []
        for at in by_owner[own_offs[x] : own_offs[x + 1]].tolist():
            lo = begin[at]
            if lo == at:
                continue
            lo += int(np.searchsorted(sizes[lo:at], least))  # skip the blocks of sets that are too small
            if lo < at:
                near = slice(lo, at)
                ok = (np.minimum(rest[near], rest[at]) >= _required(sizes[near], size[x], percent)) & ((root[owner[near]] != root[x]) | (links is not None))
                found.append(owner[near][ok])
        mine: dict[int, int] = {}
        answers.append(mine)
        if not found:
            continue
        other = np.unique(np.concatenate(found))
        if side is not None:
            other = other[side[other] != side[x]]
        like, extra = -1, 0
        for o in other[::-1].tolist():
            if root[o] == root[x] and links is None:
                continue
            need = int(_required(size[o], size[x], percent))
            bound = answers[like].get(o) if like >= 0 else None
            if bound is not None and bound + extra < need:
                mine[o] = bound + extra  # follows from the answers of a similar set
                continue
            overlap = len(np.intersect1d(coded[x], coded[o], assume_unique=True))
            if overlap < need:
                mine[o] = overlap
                continue
            if links is not None:
                links.append((int(given[o]), int(given[x])))
            low, high = sorted((int(root[o]), int(root[x])))
            root[root == high] = low
            if like < 0 or size[x] - overlap < extra:
                like, extra = o, int(size[x] - overlap)
    out = np.empty(n, np.int64)
    first = np.full(n, n)
    np.minimum.at(first, root, given)
    out[given] = first[root]
    return out


def _search(percent: int, paired: bool, every: bool):
    """Sorted rows (grp, side, id, hashes) -> links (a, b): to each component's first set, or every one."""

    def solve(ids: list[int], sets: list[np.ndarray], sides: list[int]) -> pa.RecordBatch | None:
        links: list[tuple[int, int]] | None = [] if every else None
        root = search_group(sets, percent, sides if paired and 1 in sides else None, links)
        own = np.array(ids, np.int64)
        if links is not None:
            a, b = np.array(links, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(own[b])], ["a", "b"]) if len(a) else None
        moved = np.flatnonzero(root != np.arange(len(own)))
        if not len(moved):
            return None
        return pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[root[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, sides = None, [], [], []
        for batch in batches:
            for g, side, i, h in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if g != group:
                    if len(ids) > 1 and (out := solve(ids, sets, sides)):
                        yield out
                    group, ids, sets, sides = g, [], [], []
                ids.append(i)
                sets.append(np.frombuffer(h, np.uint64))
                sides.append(side)
        if len(ids) > 1 and (out := solve(ids, sets, sides)):
            yield out

    return run


def _contents(k: int, wanted, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: Members = wanted.value
        for _, values, offs, ids in _windows(batches, k, 0, seed):
            values, offs, ids = _distinct(values, offs, ids)
            picked = np.flatnonzero(keep.has(ids))
            for at in range(0, len(picked), 512):
                part = picked[at : at + 512]
                yield pa.RecordBatch.from_arrays([pa.array(ids[part].view(np.int64)), pa.array([values[offs[i] : offs[i + 1]].tobytes() for i in part], pa.binary())], ["id", "hashes"])

    return run


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, with_first: bool = False, with_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Two documents link when 100 * |intersection| >= percent * |union| of their
    shingle sets; component_id is the smallest id reachable by links.  Null or
    wordless texts have an empty set and link with nothing.  Rows with a null id
    take part in links but never name a component (a group of such rows alone
    has a null component).  Repeated rows are copies.  Rows of one id with
    different texts are different sets; an id can so stand in several components.
    Other columns, whatever their names, are ignored.  An empty table gives none.

    with_first adds tag (xxhash64 of the text) and is_first: of each component,
    the rows with the smallest (doc_id, tag); of an empty set, every row.
    with_links adds n_links, the number of other rows that the document links
    with.  Every candidate pair of sets is then decided; without it, pairs inside
    a component are skipped as soon as that is known, which large groups of near
    copies need.  Equal sets are counted, never paired.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    for seed in range(8):
        described = scratch.table(base.mapInArrow(kernel.lean(_describe(k, seed)), "doc_id long, tag long, n_shingles long, id long, proof long, slice int, counters binary"))
        # One row for each distinct set, with the first of its documents.
        named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tag"))
        sets = described.where("slice is null and n_shingles > 0").groupBy("id")
        sets = scratch.table(sets.agg(F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"), F.min(named).alias("first"), F.min("proof").alias("low"), F.max("proof").alias("high")))
        if sets.where("low <> high").isEmpty():
            break
        scratch.drop(described, sets)
    else:
        raise RuntimeError("sets can't be told apart")
    sets = sets.select("id", "n", "copies", "first")
    links = _links(base.select("text"), described, sets, scratch, k, percent, seed, with_links)
    final = connected_components(links, scratch)
    linked = sets.join(final, "id").select("id", "root", "first")
    best = scratch.table(linked.groupBy("root").agg(F.min("first").alias("best")))
    linked = linked.join(best, "root").select("id", "best")
    counts = F.lit(None).cast("long")
    if with_links:  # links of a set: the rows of the sets it links with, and its own other rows
        ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = ends.join(sets.select(F.col("id").alias("b"), "copies"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("others"))
        linked = linked.join(others, "id", "left")
        counts = F.coalesce("others", F.lit(0)) + F.col("copies") - 1
    answers = sets.join(linked, "id", "left").select("id", F.coalesce("best", "first").alias("first"), counts.alias("n_links"))
    rows = described.where("slice is null")
    solid = rows.where("n_shingles > 0").join(scratch.table(answers), "id", "left")
    solid = solid.select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), "tag", F.struct("doc_id", "tag").eqNullSafe(F.col("first")).alias("is_first"), "n_links")
    hollow = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "tag", F.lit(True).alias("is_first"), F.lit(0).cast("long").alias("n_links"))
    out = solid.unionByName(hollow)
    return out.drop(*([] if with_first else ["tag", "is_first"]), *([] if with_links else ["n_links"]))


def _links(texts: DataFrame, described: DataFrame, sets: DataFrame, scratch: Scratch, k: int, percent: int, seed: int, every: bool) -> DataFrame:
    """(a, b) of linked sets: enough to connect each component, or every link once."""
    spark = texts.sparkSession
    frequencies = spark.sparkContext.broadcast(_frequencies(described))
    scratch.release()

    postings = sets.agg(F.sum(F.ceil(F.col("n") * (100 - percent) / 100) + SHARED)).first()[0] or 0
    buckets = max(8 * partitions(spark), int(postings) // BUCKET_POSTINGS)
    posted = texts.mapInArrow(kernel.lean(_post(k, percent, frequencies, buckets, seed)), "bucket int, token binary, owner binary, place binary, ids binary, sizes binary")
    pairs = posted.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(kernel.lean(_lists(percent)), "a long, b long, times long, need long")
    pairs = pairs.groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("need").alias("need"))
    edges = scratch.table(pairs.where("times >= need").select("a", "b"))
    del pairs
    del posted
    scratch.release()
    groups = connected_components(edges, scratch)
    wanted = spark.sparkContext.broadcast(members(groups, "id"))

    # Groups by the number of their hashes; those over the limit are cut into blocks in order of size.
    large = scratch.table(groups.join(sets.select("id", "n"), "id").groupBy("root").agg(F.sum("n").alias("weight")).where(F.col("weight") > GROUP_HASHES).select("root"))
    found = texts.mapInArrow(kernel.lean(_contents(k, wanted, seed)), "id long, hashes binary")
    links = _links_in(found, groups if large.isEmpty() else groups.join(large, "root", "left_anti"), percent, every)
    if not large.isEmpty():
        links = links.unionByName(_large_groups(scratch.table(_once(found, groups.join(large, "root"))), percent, scratch, every))
    links = scratch.table(links.distinct() if every else links)
    del found
    scratch.drop(edges, groups)
    scratch.release()
    return links


def _once(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, hashes, root): each set of the groups once; equal sets come in from many rows."""
    return found.join(groups, "id").groupBy("id").agg(F.first("hashes").alias("hashes"), F.first("root").alias("root"))


def _links_in(found: DataFrame, groups: DataFrame, percent: int, every: bool) -> DataFrame:
    sets = _once(found, groups).select(F.col("root").alias("grp"), F.lit(0).alias("side"), "id", "hashes")
    n = partitions(found.sparkSession)
    return sets.repartition(n, "grp").sortWithinPartitions("grp", "id").mapInArrow(kernel.lean(_search(percent, False, every)), "a long, b long")


def _large_groups(sets: DataFrame, percent: int, scratch: Scratch, every: bool) -> DataFrame:
    """Links inside groups that exceed one task, from pairs of blocks of near sizes.

    Sets of a group are dealt to blocks of at most a quarter of GROUP_HASHES by
    (size class, hash of the id); classes are powers of 4/3 of the size, so a set
    is compared with the blocks of its own and the next class only.
    """
    spark = sets.sparkSession
    ratio = 100.0 / percent
    n = F.length("hashes") / 8
    cells = sets.withColumn("class", F.floor(F.log(n) / F.log(F.lit(ratio))).cast("int"))
    many = cells.groupBy("root", "class").agg(F.ceil(F.sum(n) / (GROUP_HASHES // 4)).cast("int").alias("blocks"))
    many = scratch.table(many)
    # A size on the border of its class may differ by rounding; classes c, c+1 and c+2 cover it.
    ahead = many.selectExpr("root", "explode(array(class, class - 1, class - 2)) class", "class as class2", "blocks as blocks2")
    near = many.join(ahead, ["root", "class"])
    cells = cells.join(many, ["root", "class"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = cells.join(near.drop("blocks"), ["root", "class"]).select("root", "class", "block", "class2", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)).alias("block2"), F.lit(0).alias("side"), "id", "hashes")
    left = left.where("class < class2 or block <= block2")
    right = near.select("root", F.col("class2").alias("class"), F.col("class").alias("other"), F.col("blocks").alias("n_other"))
    right = cells.join(right, ["root", "class"]).select("root", F.col("other").alias("class"), F.explode(F.sequence(F.lit(0), F.col("n_other") - 1)).alias("block"), F.col("class").alias("class2"), F.col("block").alias("block2"), F.lit(1).alias("side"), "id", "hashes")
    right = right.where("class < class2 or block < block2")
    rows = left.unionByName(right).select(F.xxhash64("root", "class", "block", "class2", "block2").alias("grp"), "side", "id", "hashes")
    return rows.repartition(partitions(spark), "grp").sortWithinPartitions("grp", "side", "id").mapInArrow(kernel.lean(_search(percent, True, every)), "a long, b long")
