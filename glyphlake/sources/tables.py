"""Tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table of fewer bytes for each core may come as one block of rows, which one core would read alone.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, its rows dealt to all cores if it is small; a table of many blocks is spread by its scan, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
