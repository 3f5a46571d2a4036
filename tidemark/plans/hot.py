"""Keys which are too large for one window task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is scanned in blocks.
HOT_ROWS = 2_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys with more than ``hot_rows`` rows, or None if there are none.

    The list is collected: it has fewer than rows / ``hot_rows`` entries by definition.
    The count reads the key columns only and combines before its shuffle.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    found = counts.where(F.col("_rows") > hot_rows).select(*keys)
    rows = found.collect()
    if not rows:
        return None
    return df.sparkSession.createDataFrame(rows, found.schema)
