"""Corpus lines and file trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders of builds, packages and version control that a walk leaves out, besides those whose names start with a dot.
SKIPPED = ["node_modules", "__pycache__", "venv", "dist", "build", "target"]


def corpus_texts(lines: DataFrame, field: str = "text", value_col: str = "value") -> DataFrame:
    """lines with ``text``: of a JSON object its string field (the line is dropped without one), else the trimmed line; empty lines are dropped.

    A line that starts like an object but is no JSON is taken as it stands; a
    field that holds anything but a string is none.
    """
    line = F.trim(F.regexp_replace(F.col(value_col), r"^\s+|\s+$", ""))
    row = F.try_parse_json(F.when(line.startswith("{"), line))
    path = f"$['{field}']"
    held = F.try_variant_get(row, path, "string")
    is_string = F.schema_of_variant(F.try_variant_get(row, path, "variant")) == "STRING"
    text = F.when(row.isNotNull(), F.when(is_string, held)).otherwise(line)
    return lines.withColumn("text", text).where("text is not null and text <> ''")


def read_corpus(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    return corpus_texts(spark.read.text(path), field).select("text")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def walked(path_col: str, root: str, skipped: list[str] | None = None):
    """Whether a path below root is in no folder that a walk leaves out; root itself may have any name."""
    names = [*SKIPPED, *(skipped or [])]
    quoted = "|".join(n.replace(".", r"\.") for n in names)
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    below = F.substr(plain(F.col(path_col)), F.length(plain(F.lit(root.rstrip("/")))) + 1)
    return ~below.rlike(rf"/(?:\.[^/]+|{quoted})/")


def read_files(spark: SparkSession, path: str, max_bytes: int = 256 << 20, skipped: list[str] | None = None) -> DataFrame:
    """(path, length, content, error) of all files below; larger files have an error and no content.

    The length is checked before content is read.  Hidden and build folders below
    the root, and those of ``skipped``, are left out; the root is never.  Spark
    itself leaves out files whose own names start with a dot or an underscore.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(conf).makeQualified(at).toString()
    files = files.where(walked("path", root, skipped)).select("path", "length", "content")
    small = files.where(F.col("length") <= max_bytes).withColumn("error", F.lit(None).cast("string"))
    large = files.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit("too large").alias("error"))
    return small.unionByName(large)
