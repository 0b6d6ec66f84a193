"""Intermediate tables that survive lost executors, and bounded membership filters.

Lineage is cut with Parquet tables in the shared folder that the cluster names
in ``spark.checkpoint.dir`` or that was given to SparkContext.setCheckpointDir.
A folder of our own is used only in a local session, where driver and executors
share one machine; any other session without a shared folder is refused.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Where driver and executors both read and write; an error if a cluster names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"no shared folder for intermediate tables: set spark.checkpoint.dir (master is {master})")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="glyphlake-")
    return _own["dir"]


class Scratch:
    """Writes intermediate tables and drops them when they have been used; what is left goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/glyphlake-{uuid.uuid4().hex}"
        self.count = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def table(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self) -> None:
        """Lets Spark delete the shuffle files of plans that are no longer referenced.

        The JVM hears of Python's dead objects through a queue that a thread
        empties once a second; it is emptied here first.  What a first collection
        sets free holds the last plan's shuffles, so there is a second.  Otherwise
        the next shuffle's files would stand beside the last one's.
        """
        gc.collect()
        queue = getattr(self.spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
        while queue:
            try:
                task = queue.pop()
            except IndexError:
                break
            if not isinstance(task, tuple):  # the thread's own sign to end
                queue.append(task)
                break
            client, dead = task
            client.garbage_collect_object(dead, False)
        collect = self.spark._jvm.System.gc
        collect()
        time.sleep(0.3)
        collect()

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a membership filter for each member, and the least and most bits of a
#: filter (2 MB and 128 MB).  Past 32 million members it lets more and more
#: strangers through, which costs work in the exact step behind it but never a
#: result.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 24, 1 << 30
_SLICES = 64


def filter_bits(count: int) -> int:
    """Bits of a filter of ``count`` members: a power of two between LEAST_BITS and MOST_BITS."""
    return min(max(1 << (BITS_EACH * max(count, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)


def _slots(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slice of each id and its two bits inside the slice."""
    ids = ids.astype(np.uint64)
    slice_of = (ids >> np.uint64(58)).astype(np.int64)
    width = np.uint64(bits // _SLICES)
    one = (ids * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(20)
    two = (ids * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(20)
    return slice_of, (one % width).astype(np.int64), (two % width).astype(np.int64)


class Members:
    """Approximate set of 64-bit ids, of a size bounded by MOST_BITS; never misses a member."""

    def __init__(self, data: dict[int, bytes], size: int):
        self.size = size
        empty = bytes(size // _SLICES // 8)
        self.bits = np.frombuffer(b"".join(data.get(i, empty) for i in range(_SLICES)), np.uint8)

    def __contains__(self, ids: np.ndarray):
        raise TypeError("use has()")

    def has(self, ids: np.ndarray) -> np.ndarray:
        slice_of, one, two = _slots(ids, self.size)
        base = slice_of * (self.size // _SLICES)
        one, two = base + one, base + two
        return (((self.bits[one >> 3] >> (one & 7).astype(np.uint8)) & (self.bits[two >> 3] >> (two & 7).astype(np.uint8))) & 1).astype(bool)


def members(df: DataFrame, column: str) -> Members:
    """The filter of a column of distinct 64-bit ids: its size follows their count, each slice is made in one task, and only the bits (at most MOST_BITS) come to the driver."""
    spark = df.sparkSession
    size = filter_bits(df.count())
    width = size // _SLICES

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            slice_of, one, two = _slots(batch.column(0).to_numpy(zero_copy_only=False), size)
            for s in np.unique(slice_of).tolist():
                bits = made.setdefault(s, np.zeros(width, bool))
                bits[one[slice_of == s]] = True
                bits[two[slice_of == s]] = True
        if made:
            yield pa.RecordBatch.from_pydict({"s": pa.array(list(made), pa.int32()), "bits": [np.packbits(b, bitorder="little").tobytes() for b in made.values()]})

    ids = df.select(F.col(column).cast("long").alias("id"))
    by_slice = ids.repartition(min(_SLICES, partitions(spark)), F.shiftrightunsigned("id", 58))
    rows = by_slice.mapInArrow(fill, "s int, bits binary").collect()
    merged: dict[int, np.ndarray] = {}
    for row in rows:
        part = np.frombuffer(bytes(row.bits), np.uint8)
        merged[row.s] = merged[row.s] | part if row.s in merged else part
    return Members({s: b.tobytes() for s, b in merged.items()}, size)
