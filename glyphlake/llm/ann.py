"""Approximate nearest neighbours by inner product, with balanced posting lists.

Largest inner product becomes smallest distance by one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm (0 for queries).  Then:

1. equal vectors are one vector with its smallest ids;
2. centroids come from balanced bisection of a bounded sample: each cell is cut
   at the median between two means, so lists start out with equal shares;
3. centroids form a neighbour graph in memory, searched best first by a beam for
   many vectors at a time;
4. every vector goes to the list of its nearest centroid, and a vector near a
   boundary (other centroids within ``boundary_ratio`` of the nearest's
   distance) to those lists too, up to ``replicas`` in all;
5. a query reads the lists whose centroids' distances stay within a ratio of the
   nearest's.  Neighbouring lists are stored as one block, to which a query is
   sent once with the numbers of its lists there; a list too long for a block is
   cut, and so are many queries of a block.  Each cell of vectors and queries is
   searched exactly, list by list, and gives each query its best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .kernel import ragged
from .scratch import Scratch, partitions

#: Bounds of the in-memory part: centroids, sampled vectors for each, and sampled vectors in all.
MAX_LISTS = 16_384
SAMPLE_PER_LIST = 64
MAX_SAMPLE = 65_536
#: Lists that there are at least if they get LEAST_SIZE vectors each, vectors for each list that their number aims at, vectors of a block at least (where there are so few that each partition gets one) and at most, and queries that meet a block in one task.
MIN_LISTS = 16
LEAST_SIZE = 8
LIST_SIZE = 256
LEAST_BLOCK, BLOCK = 4096, 65_536
QUERIES = 262_144
#: Queries searched at a time.
SOLVED = 2048
_SALTS = 64


def bisect(points: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Means of ``lists`` (rounded up to a power of two, at most one a point) cells of equal size."""
    rng = np.random.default_rng(seed)
    cells = [points]
    while len(cells) < lists and max(map(len, cells)) > 1:
        halves = []
        for cell in cells:
            if len(cell) < 2:
                halves.append(cell)
                continue
            means = cell[rng.choice(len(cell), 2, replace=False)]
            for _ in range(6):
                lean = ((cell - means[0]) ** 2).sum(1) - ((cell - means[1]) ** 2).sum(1)
                near = np.argpartition(lean, len(cell) // 2)
                first, second = near[: len(cell) // 2], near[len(cell) // 2 :]
                means = np.stack([cell[first].mean(0), cell[second].mean(0)])
            halves += [cell[first], cell[second]]
        cells = halves
    return np.stack([c.mean(0) for c in cells])


class CentroidGraph:
    """Centroids with edges to near and varied others; best-first beam search over it."""

    def __init__(self, centroids: np.ndarray, degree: int = 24):
        self.c = centroids.astype(np.float32)
        n = len(self.c)
        degree = min(degree, n - 1)
        self.norm = (self.c**2).sum(1)
        self.links = np.zeros((n, max(degree, 1)), np.int64)
        for s in range(0, n, 1024):
            d = self.norm[None, :] - 2 * self.c[s : s + 1024] @ self.c.T
            d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
            near = np.argsort(d, 1)[:, : 3 * degree]
            for i, row in enumerate(near):
                keep: list[int] = []  # relative neighbourhood: skip what is nearer to one that is kept
                gap = self.norm[row][:, None] + self.norm[row][None, :] - 2 * self.c[row] @ self.c[row].T
                own = d[i, row] + self.norm[s + i]
                for j in range(len(row)):
                    if len(keep) < degree and not (keep and (gap[j, keep] < own[j]).any()):
                        keep.append(j)
                rest = [j for j in range(len(row)) if j not in keep]
                self.links[s + i] = row[(keep + rest)[:degree]] if degree else 0
        step = max(1, n // 64)
        self.entries = np.arange(0, n, step)  # cells in tree order: spread over the space

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of about the ``beam`` nearest centroids of each row, nearest first."""
        x = x.astype(np.float32)
        n, k = len(x), len(self.c)
        beam = min(beam, k)
        own = (x**2).sum(1)
        seen = np.zeros((n, k), bool)
        d = self.norm[self.entries][None, :] - 2 * x @ self.c[self.entries].T
        take = np.argsort(d, 1)[:, :beam]
        ids = self.entries[take]
        dist = np.take_along_axis(d, take, 1)
        seen[:, self.entries] = True
        if ids.shape[1] < beam:
            pad = beam - ids.shape[1]
            ids = np.pad(ids, ((0, 0), (0, pad)))
            dist = np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)
        done = np.isinf(dist)
        rows = np.arange(n)
        last = np.zeros((n, k), np.int32)
        width = max(1, beam // 8)  # centroids expanded in one step
        while len(rows):
            open_ = np.where(done[rows], np.inf, dist[rows])
            best = np.argpartition(open_, min(width, beam) - 1, 1)[:, :width]
            usable = np.isfinite(np.take_along_axis(open_, best, 1))
            alive = usable.any(1)
            rows, best, usable = rows[alive], best[alive], usable[alive]
            if not len(rows):
                break
            done[rows[:, None], best] |= usable
            next_ = self.links[ids[rows[:, None], best]].reshape(len(rows), -1)
            at = np.broadcast_to(np.arange(next_.shape[1], dtype=np.int32), next_.shape)
            last[rows[:, None], next_] = at
            fresh = ~seen[rows[:, None], next_] & (last[rows[:, None], next_] == at) & np.repeat(usable, self.links.shape[1], 1)
            r, c = np.nonzero(fresh)
            new = next_[r, c]
            seen[rows[r], new] = True
            gap = np.full(next_.shape, np.inf, np.float32)
            gap[r, c] = self.norm[new] - 2 * np.einsum("ij,ij->i", x[rows[r]], self.c[new])
            all_d = np.concatenate((dist[rows], gap), 1)
            order = np.argpartition(all_d, beam - 1, 1)[:, :beam]
            dist[rows] = np.take_along_axis(all_d, order, 1)
            ids[rows] = np.take_along_axis(np.concatenate((ids[rows], next_), 1), order, 1)
            done[rows] = np.take_along_axis(np.concatenate((done[rows], np.isinf(gap)), 1), order, 1)
        order = np.argsort(dist, 1)
        return np.take_along_axis(ids, order, 1), np.maximum(np.take_along_axis(dist, order, 1) + own[:, None], 0)


def _matrix(rows: list[bytes], dim: int, kind: str) -> np.ndarray:
    """Vectors in double precision, from the bytes of the kind that holds them exactly."""
    return np.frombuffer(b"".join(rows), kind).reshape(-1, dim).astype(np.float64)


def _to_bytes(kind: str):
    """(id, list of floats) -> (id, dim, bytes, squared norm) of vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _packed(batch, kind)

    return run


def _packed(batch: pa.RecordBatch, kind: str) -> pa.RecordBatch:
    ids, rows, dims, norms = [], [], [], []
    for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if i is None or not v or None in v:
            continue
        x = np.array(v, np.float64) + 0.0  # -0.0 equals 0.0
        square = float(x @ x)
        if np.isfinite(x).all() and x.any() and np.isfinite(square):
            ids.append(i)
            rows.append(x.astype(kind).tobytes())
            dims.append(len(x))
            norms.append(square)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(rows, pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "dim", "vec", "square"])


class _Index:
    """Centroid graph, vector dimension and kind, largest squared norm, and how lists are chosen."""

    def __init__(self, graph: CentroidGraph, dim: int, kind: str, largest: float, replicas: int, boundary_ratio: float):
        self.graph, self.dim, self.kind, self.largest = graph, dim, kind, largest
        self.replicas, self.boundary_ratio = replicas, boundary_ratio
        self.probe_ratio, self.beam = 1.0, 16

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the nearest list of each vector, and those just over a boundary."""
        c = self.graph.c
        extra = np.sqrt(np.maximum(self.largest - (x**2).sum(1), 0))
        ids, dist = self.graph.search(np.concatenate((x, extra[:, None]), 1), 16)
        near = dist[:, : self.replicas] <= self.boundary_ratio**2 * dist[:, :1]
        near[:, 0] = True
        row, column = np.nonzero(near)
        return row, ids[row, column]

    def probes_of(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists that each query reads."""
        ids, dist = self.graph.search(np.concatenate((q, np.zeros((len(q), 1))), 1), self.beam)
        row, column = np.nonzero(dist <= self.probe_ratio**2 * dist[:, :1])
        return row, ids[row, column]

    def calibrate(self, sample: np.ndarray, k: int, recall: float, share: float = 1.0, queries: int = 512) -> None:
        """Sets the probe ratio that finds ``recall`` of the k nearest, and the beam that covers it.

        A sample of ``share`` of all vectors holds about that share of the k
        nearest; so many of its own nearest stand for them.
        """
        k = max(1, round(k * share))
        c = self.graph.c
        # A search takes memory for each vector and centroid: like all other callers, a thousand at a time.
        parts = [self.lists_of(sample[at : at + 1024]) for at in range(0, len(sample), 1024)]
        row = np.concatenate([r + 1024 * i for i, (r, _) in enumerate(parts)])
        lists = np.concatenate([x for _, x in parts])
        own = np.arange(0, len(sample), max(1, len(sample) // queries))
        ratios, needed = [], []
        for part in np.array_split(own, 1 + len(own) // 64):
            q = sample[part]
            scores = q @ sample.T
            scores[np.arange(len(q)), part] = -np.inf
            near = np.argsort(-scores, 1)[:, : min(k, len(sample) - 1)]
            dist = (q**2).sum(1)[:, None] + self.graph.norm[None, :] - 2 * q @ c[:, :-1].T.astype(np.float64)
            dist = np.sqrt(np.maximum(dist, 0))
            ratios.append(dist / np.maximum(dist.min(1, keepdims=True), 1e-12))
            least = np.full((len(q), len(sample)), np.inf)
            for some in np.array_split(np.arange(len(row)), 1 + len(row) // 4096):
                np.minimum.at(least.T, row[some], ratios[-1][:, lists[some]].T)
            needed.append(np.take_along_axis(least, near, 1).ravel())
        found = np.concatenate(needed)
        self.probe_ratio = float(np.quantile(found, recall)) * (1 + 1e-6) if found.size else 1.0
        self.beam = max(16, int(np.quantile(np.concatenate([(r <= self.probe_ratio).sum(1) for r in ratios]), 0.99)) + 1)


def _assign(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                row, lists = index.value.lists_of(_matrix(batch.column(1).to_pylist(), index.value.dim, index.value.kind))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *(c.take(row) for c in batch.columns)], ["list", "class_id", "vec", "members"])

    return run


def _probe(index, block_of):
    """Rows (class_id, vec) -> a row for each block that holds lists which the query reads, with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                row, lists = index.value.probes_of(_matrix(batch.column(1).to_pylist(), index.value.dim, index.value.kind))
                order = np.lexsort((lists, row))
                row, lists = row[order], lists[order]
                block = block_of.value[lists]
                row, lists, block = row[block >= 0], lists[block >= 0].astype(np.uint16), block[block >= 0]
                head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])))[: len(row)])
                read = [x.tobytes() for x in np.split(lists, head[1:])] if len(head) else []
                yield pa.RecordBatch.from_arrays([pa.array(block[head].astype(np.int32)), *(c.take(pa.array(row[head])) for c in batch.columns), pa.array(read, pa.binary())], ["block", "class_id", "vec", "read"])

    return run


def _best(row: np.ndarray, at: np.ndarray, score: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best (row, vector, score) of each row, each vector once; of equal scores those with the smallest first ids."""
    order = np.lexsort((first[at], row))
    row, at, score = row[order], at[order], score[order]
    once = np.concatenate(([True], (row[1:] != row[:-1]) | (first[at[1:]] != first[at[:-1]])))[: len(row)]
    row, at, score = row[once], at[once], score[once]
    order = np.lexsort((first[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[top], at[top], score[top]


def _scan(dim: int, kind: str, k: int):
    """Sorted rows (cell, query?, list, class_id, vec, read, members) -> each query's best of those vectors of the cell that are in lists it reads."""

    def solve(stored: list, queries: list) -> pa.RecordBatch:
        x = _matrix([s[2] for s in stored], dim, kind)
        lists, begin = np.unique(np.array([s[0] for s in stored]), return_index=True)
        end = np.append(begin[1:], len(stored))
        count = np.array([len(s[4]) for s in stored])
        members = np.array([i for s in stored for i in s[4]], np.int64)
        offs = np.cumsum(count) - count
        first = members[offs]
        q = _matrix([p[2] for p in queries], dim, kind)
        asked = np.concatenate([np.frombuffer(p[3], np.uint16) for p in queries]).astype(np.int64)
        asker = np.repeat(np.arange(len(queries)), [len(p[3]) // 2 for p in queries])
        order = np.argsort(asked, kind="stable")
        asked, asker = asked[order], asker[order]
        cut = np.full(len(queries), -np.inf)  # what a vector needs to be among the best so far
        held, size = [], 0
        for one, s, e in zip(lists.tolist(), begin.tolist(), end.tolist(), strict=True):
            own = asker[np.searchsorted(asked, one) : np.searchsorted(asked, one, "right")]
            if not len(own):
                continue
            for at in range(s, e, LEAST_BLOCK):
                some = x[at : min(at + LEAST_BLOCK, e)]
                scores = q[own] @ some.T
                fresh = np.flatnonzero(np.isinf(cut[own]))
                if len(fresh) and len(some) > k:
                    cut[own[fresh]] = np.partition(scores[fresh], len(some) - k, 1)[:, len(some) - k]
                r, c = np.nonzero(scores >= cut[own][:, None])
                held.append((own[r], at + c, scores[r, c]))
                size += len(r)
                if size > 4 * k * len(queries):
                    held = [_best(*(np.concatenate(h) for h in zip(*held, strict=True)), first, k)]
                    row, _, score = held[0]
                    last = np.flatnonzero(np.append(row[1:] != row[:-1], True))
                    full = last[np.bincount(row, minlength=len(queries))[row[last]] == k]
                    cut[row[full]] = np.maximum(cut[row[full]], score[full])
                    size = len(row)
        none = np.zeros(0, np.int64)
        row, at, score = _best(*(np.concatenate(h) for h in zip(*held, strict=True)), first, k) if held else (none, none, np.zeros(0))
        of = count[at]
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, of, len(queries)).astype(np.int64)))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(members[ragged(offs[at], of)]))
        values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.repeat(score, of)))
        return pa.RecordBatch.from_arrays([pa.array([p[1] for p in queries], pa.int64()), ids, values], ["class_id", "ids", "scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, stored, queries = None, [], []
        for batch in batches:
            for g, is_query, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != cell:
                    if stored and queries:
                        yield solve(stored, queries)
                    cell, stored, queries = g, [], []
                if is_query:
                    queries.append(row)
                    if len(queries) == SOLVED:  # the cell's vectors come first; any number of queries may follow
                        if stored:
                            yield solve(stored, queries)
                        queries = []
                else:
                    stored.append(row)
        if stored and queries:
            yield solve(stored, queries)

    return run


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scores = [], []
            for parts, values in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                best = dict(zip((i for p in parts for i in p), (v for p in values for v in p), strict=True))
                top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
                ids.append([i for i, _ in top])
                scores.append([v for _, v in top])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], ["class_id", "ids", "scores"])

    return run


def nearest_neighbours(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, replicas: int = 3, boundary_ratio: float = 1.02, recall: float = 0.96
) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id divides by ``every``, the k nearest others found.

    score is the inner product in double precision on the original vectors; ties
    go to the smaller id; ``recall`` is the share that the sample's calibration
    asks for.  A query with fewer than k others gets all that it
    finds.  Rows with a null id, and vectors that are null, empty, zero, or hold
    a null or a component that is not finite, take no part, nor do vectors of
    another dimension than the most frequent one (ties: the smaller).  Repeated
    rows are one row; other columns, whatever their names, are ignored; an empty
    table gives none.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    n = partitions(spark)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    kind = "<f4" if isinstance(getattr(vectors.schema[vec_col].dataType, "elementType", None), FloatType) else "<f8"
    whole = scratch.table(base.mapInArrow(_to_bytes(kind), "vec_id long, dim int, vec binary, square double"))
    empty = "query_id long, rank int, vec_id long, score double"
    main = whole.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if main is None:
        return spark.createDataFrame([], empty)
    dim = main["dim"]
    rows = whole.where(F.col("dim") == dim)
    largest = rows.agg(F.max("square")).first()[0]

    # Equal vectors: the k + 1 smallest ids of each, in two steps so that a frequent vector never meets whole.
    one = rows.select("vec", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS)).alias("salt"))
    for keys in (["vec", "salt"], ["vec"]):
        one = one.withColumn("n", F.dense_rank().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n")
    classes = one.groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("members"))
    classes = scratch.table(classes.select(F.xxhash64("vec").alias("class_id"), "vec", "members"))
    # Every query takes its vector's answer without itself.
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "vec").distinct().join(classes.select("vec", "class_id"), "vec")
    asked = scratch.table(asked.select(F.col("vec_id").alias("query_id"), "class_id"))
    scratch.drop(whole)
    del one, rows, whole
    scratch.release()
    total = classes.count()
    lists = min(MAX_LISTS, max(total // LIST_SIZE, min(MIN_LISTS, total // LEAST_SIZE), 1))
    # The sample is drawn by hash where the vectors are; a global order would send every partition's share of that size to the driver.
    size = min(SAMPLE_PER_LIST * lists, MAX_SAMPLE)
    draw = F.pmod("class_id", F.lit(1 << 40))
    sample = classes.where(draw < int(min(1.0, 1.05 * size / total) * (1 << 40))).select(draw.alias("draw"), "vec").toPandas()
    sample = [v for _, v in sorted(zip(sample["draw"], map(bytes, sample["vec"]), strict=True))[:size]]
    points = _matrix(sample, dim, kind)
    points = np.concatenate((points, np.sqrt(np.maximum(largest - (points**2).sum(1), 0))[:, None]), 1)
    fitted = _Index(CentroidGraph(bisect(points, lists)), dim, kind, largest, replicas, boundary_ratio)
    checked = points[:32_768, :-1]
    fitted.calibrate(checked, k, recall, len(checked) / max(total, 1))
    index = spark.sparkContext.broadcast(fitted)

    stored = scratch.table(classes.mapInArrow(_assign(index), "list int, class_id long, vec binary, members array<long>"))
    # Neighbouring lists (in the order of the bisection) make a block; one row comes for each of at most MAX_LISTS lists.
    sizes = dict(stored.groupBy("list").count().collect())
    aim = min(BLOCK, max(sum(sizes.values()) // n, LEAST_BLOCK))
    block_of, blocks, held = np.full(len(fitted.graph.c), -1), [], aim
    for one in sorted(sizes):
        if held + sizes[one] > aim:
            blocks.append(0)
            held = 0
        held += sizes[one]
        block_of[one] = len(blocks) - 1
        blocks[-1] = max(1, -(-held // BLOCK))  # more than one: a list that is cut
    shared = spark.sparkContext.broadcast(block_of)
    queries = classes.join(asked.select("class_id").distinct(), "class_id").select("class_id", "vec")
    probes = scratch.table(queries.mapInArrow(_probe(index, shared), "block int, class_id long, vec binary, read binary"))
    scratch.drop(classes)
    del classes, queries
    scratch.release()
    asks = dict(probes.groupBy("block").count().collect())
    cuts, cells = [], 0
    for b, parts in enumerate(blocks):
        groups = -(-asks.get(b, 0) // QUERIES)
        cuts.append((b, parts, groups, cells))
        cells += parts * groups
    cuts = F.broadcast(spark.createDataFrame(cuts, "block int, parts int, groups int, cell long").where("groups > 0"))
    place = F.broadcast(spark.createDataFrame([(one, int(block_of[one])) for one in sorted(sizes)], "list int, block int"))
    own = lambda parts, salt: F.pmod(F.xxhash64("class_id", F.lit(salt)), F.col(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = stored.join(place, "list").join(cuts, "block").withColumn("group", each("groups"))
    left = left.select((F.col("cell") + own("parts", 1) * F.col("groups") + F.col("group")).alias("cell"), F.lit(False).alias("is_query"), "list", "class_id", "vec", F.lit(None).cast("binary").alias("read"), "members")
    right = probes.join(cuts, "block").withColumn("part", each("parts"))
    right = right.select((F.col("cell") + F.col("part") * F.col("groups") + own("groups", 2)).alias("cell"), F.lit(True).alias("is_query"), F.lit(0).alias("list"), "class_id", "vec", "read", F.lit(None).cast("array<long>").alias("members"))
    meet = left.unionByName(right).repartitionById(n, F.pmod("cell", F.lit(n)).cast("int")).sortWithinPartitions("cell", "is_query", "list", "class_id")
    found = meet.mapInArrow(_scan(dim, kind, k + 1), "class_id long, ids array<long>, scores array<double>")
    best = found.groupBy("class_id").agg(F.collect_list("ids").alias("ids"), F.collect_list("scores").alias("scores"))
    best = best.mapInArrow(_merge(k + 1), "class_id long, ids array<long>, scores array<double>")
    pairs = asked.join(best, "class_id").select("query_id", F.expr("filter(arrays_zip(ids, scores), x -> x.ids <> query_id)").alias("near"))
    out = pairs.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
