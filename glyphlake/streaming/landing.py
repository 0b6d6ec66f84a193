"""Audit of files as they land: a file stream that takes each file once, whole, and appends its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import reports

_FILES = "path string, modificationTime timestamp, length long, content binary"


def audit_batch(files: DataFrame, max_bytes: int) -> DataFrame:
    """(path, kind, has_c2pa, has_ai_metadata, suspicious_total, findings, confidence, notes, error) of files; larger ones have an error."""
    whole = files.withColumn("content", F.when(F.col("length") <= max_bytes, F.col("content")))
    x = reports.inspect_files(whole)
    items = reports.audit_items(x).withColumn("error", F.lit(None).cast("string"))
    return items.unionByName(reports.audit_skipped(x).withColumnRenamed("reason", "error"), allowMissingColumns=True)


def audit_landing(spark: SparkSession, folder: str, out: str, checkpoint: str, max_bytes: int = reports.TOO_LARGE) -> StreamingQuery:
    """Audits all files that are there now and were not seen before."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is run again replaces its own part.
        audit_batch(batch, max_bytes).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
