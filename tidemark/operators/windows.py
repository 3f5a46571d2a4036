"""Row windows over a stream with positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.scan import BLOCK_ROWS, with_halo


def sliding_mean(
    df: DataFrame,
    hit: Column,
    rows: int,
    name: str,
    group: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean of ``hit`` over the last ``rows`` rows, the current one included.

    Blocks carry a copy of the rows just before them, so that every block is one window
    group of its own whatever the size of the stream.
    """
    copied = with_halo(df.withColumn("_hit", hit.cast("int")), rows - 1, block_rows=block_rows)
    last = Window.partitionBy(*group, "block").orderBy("pos").rowsBetween(-(rows - 1), 0)
    return (
        copied.withColumn(name, F.sum("_hit").over(last).cast("double") / F.count("_hit").over(last))
        .where(~F.col("halo"))
        .drop("block", "halo", "_hit")
    )
