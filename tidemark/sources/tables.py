"""Readers and writers: CSV and Parquet with a declared schema, shards, the drift log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import DRIFT_LOG


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """CSV with header; texts may hold quotes and, with ``multi_line``, line breaks.

    With ``multi_line`` a file cannot be split, so one task reads it whole: for small files.
    ``csv_records.read_csv_in_parallel`` reads files of any size with line breaks inside texts.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_shards(df: DataFrame, path: str, rows_per_file: int = 2_000_000) -> None:
    """One folder per shard, with files of consecutive rows.

    A shard of any size is cut by position, so no task writes more than ``rows_per_file``.
    """
    pieces = df.withColumn("_piece", F.floor(F.col("pos") / rows_per_file))
    pieces.repartition("shard", "_piece").drop("_piece").write.mode("overwrite").partitionBy(
        "shard"
    ).parquet(path)


def read_shard(spark: SparkSession, path: str, schema: T.StructType, shard: int) -> DataFrame:
    """The rows of one shard; the other folders are not opened."""
    return spark.read.schema(schema).parquet(path).where(F.col("shard") == shard)


def write_drift_log(log: DataFrame, path: str, run_id: str) -> None:
    """Add a run to the log; runs and shards have folders of their own."""
    log.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id", "shard").parquet(path)


def read_drift_log(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The tests of one run; a run without any has no rows."""
    schema = T.StructType([*DRIFT_LOG.fields, T.StructField("run_id", T.StringType())])
    return spark.read.schema(schema).parquet(path).where(F.col("run_id") == run_id)
