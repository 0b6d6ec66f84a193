"""The engine as a library: files to reports, detections, audits and documents.  Every function takes and returns DataFrames.

A file is a row (path, content), as ``read_files`` gives them.
"""

from __future__ import annotations

import os
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import reports
from .functions.codepoints import CleanOptions, clean_text, inspect_text
from .functions.keyed import replay_test
from .functions.style import marker_matches, style_measures, style_score
from .operators.evaluation import batch_counters
from .sources.corpus import read_corpus, read_files

__all__ = ["CleanOptions", "audit", "batch_counters", "clean_text", "detect", "files_of", "inspect", "inspect_text", "marker_matches", "read_corpus", "read_files", "replay_test", "standard_input", "style_measures", "style_score", "text_audit"]

text_audit = reports.text_audit


#: Bounds in bytes of a file, unless the environment names another, and of the standard input.
MAX_FILE = int(os.environ.get("GLYPHLAKE_MAX_INPUT_BYTES") or reports.TOO_LARGE)
MAX_INPUT = 64 << 20


def standard_input(spark: SparkSession, stream=None) -> DataFrame:
    """The standard input as one file of text; ValueError if it is over MAX_INPUT."""
    data = (stream or sys.stdin.buffer).read(MAX_INPUT + 1)
    if len(data) > MAX_INPUT:
        raise ValueError(f"standard input exceeds {MAX_INPUT} bytes")
    return spark.createDataFrame([("<stdin>.txt", len(data), bytearray(data), None)], "path string, length long, content binary, error string")


def files_of(spark: SparkSession, paths: list[str], skipped: list[str] | None = None) -> DataFrame:
    """All files of some folders or files, and of the standard input for ``-``, with (path, length, content, error)."""
    parts = [standard_input(spark) if path == "-" else read_files(spark, path, MAX_FILE, skipped) for path in paths]
    return reduce(DataFrame.unionByName, parts)


def inspect(files: DataFrame, *, forced: str = "", force_text: bool = False, style: bool = False, threshold: float = reports.STYLE_THRESHOLD) -> DataFrame:
    """(path, report, suspicious), and style_score if asked for; an error of the file itself becomes the report's."""
    x = reports.inspect_files(files, forced=forced, force_text=force_text)
    if "error" in files.columns:
        x = x.withColumn("report", F.col("report").withField("error", F.coalesce("error", "report.error")))
    if not style:
        return x.select("path", "report", reports.is_suspicious(F.col("report")).alias("suspicious"))
    x = reports.styled(x)
    return x.select("path", "report", "style_score", reports.is_suspicious(F.col("report"), F.col("style_score"), threshold).alias("suspicious"))


def detect(files: DataFrame, *, key: str = "", threshold: float = reports.STYLE_THRESHOLD) -> DataFrame:
    """(path, report, detections, detected)."""
    x = reports.detect(reports.inspect_files(files), key=key, threshold=threshold)
    return x.select("path", "report", "detections", reports.any_positive(F.col("detections")).alias("detected"))


def audit(files: DataFrame, *, style: bool = False, threshold: float = reports.STYLE_THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, skipped files, summary)."""
    x = reports.inspect_files(files)
    if "error" in files.columns:
        x = x.withColumn("report", F.col("report").withField("error", F.coalesce("error", "report.error")))
    if style:
        x = reports.styled(x)
    items = reports.audit_items(x, style_col="style_score" if style else None, threshold=threshold)
    return items, reports.audit_skipped(x), reports.audit_summary(items)
