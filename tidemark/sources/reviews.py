"""The reviews view over the driver's ``events`` and ``documents`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows cost much to work on.

    A table in fewer pieces than there are cores (one small file, one row group) is spread
    over them; a table of many files is left as it is, without a shuffle.
    """
    df = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def reviews_from(events: DataFrame, n_documents: int) -> DataFrame:
    return events.select(
        F.col("event_id").alias("review_id"),
        "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("product_id"),
        (F.lit(1) + (F.col("event_id") * 7 + F.col("user_id")) % 5).cast("int").alias("rating"),
        "ts",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.when(F.col("event_type") == "error", "fake").otherwise("nofake").alias("label"),
        (F.col("event_id") % n_documents).alias("doc_id"),
    )


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """One review per event; its text is the document ``doc_id``."""
    # The count is read from the file footers.
    n_documents = table(spark, folder, "documents").count()
    return reviews_from(table(spark, folder, "events"), n_documents)
