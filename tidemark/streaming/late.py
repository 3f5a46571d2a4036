"""Late rows as a table: a stream is parted by its watermark before any state sees it.

The watermark of a micro-batch is the latest event time of all batches before it, less the delay:
the engine's own rule.  Rows behind it go to the late table, all others on; both land in a folder
per batch which is replaced when the batch is run again, beside one row with the latest time so
far.  So a restart parts the rows as the first run did, and none is lost or doubled.  A stream
over the rows which went on has no late rows of its own with the same delay.

Rows without event time go on (what follows decides on them).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.streaming.source import row_stream

_MARK = "latest timestamp"


@dataclass(frozen=True)
class Parted:
    """Where a parted stream lies."""

    folder: str
    schema: T.StructType

    @property
    def state(self) -> str:
        return f"{self.folder}/state"

    def on_time(self, spark: SparkSession, files_per_batch: int = 16) -> DataFrame:
        """The rows which were on time, as a stream."""
        return row_stream(spark, f"{self.folder}/rows", self.schema, files_per_batch, nested=True)

    def late(self, spark: SparkSession) -> DataFrame:
        """The late rows, with the ``watermark`` they were behind."""
        schema = T.StructType([*self.schema.fields, T.StructField("watermark", T.TimestampType())])
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/late")


def parting(folder: str, event_time: str, delay: str) -> Callable[[DataFrame, int], None]:
    """The sink which parts micro-batches."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = None
        if number:
            row = spark.read.schema(_MARK).parquet(f"{folder}/marks/{number - 1:09d}").first()
            before = row.latest if row else None
        at = F.col(event_time).cast("timestamp")
        limit = F.lit(before).cast("timestamp") - F.expr(f"interval {delay}")
        behind = F.coalesce(at < limit, F.lit(False))
        kept = batch.persist()
        try:
            kept.where(~behind).write.mode("overwrite").parquet(f"{folder}/rows/{number:09d}")
            kept.where(behind).withColumn("watermark", limit).write.mode("overwrite").parquet(f"{folder}/late/{number:09d}")
            latest = kept.agg(F.greatest(F.max(at), F.lit(before).cast("timestamp")).alias("latest"))
            latest.write.mode("overwrite").parquet(f"{folder}/marks/{number:09d}")
        finally:
            kept.unpersist()

    return write


def part_late_rows(stream: DataFrame, folder: str, event_time: str = "ts", delay: str = "7 days") -> Parted:
    """Take in what the source of ``stream`` holds now; a later call with the same folder goes on from there."""
    parted = Parted(folder, stream.schema)
    query = (
        stream.writeStream.foreachBatch(parting(folder, event_time, delay))
        .option("checkpointLocation", parted.state)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return parted


__all__ = ["Parted", "part_late_rows", "parting"]
