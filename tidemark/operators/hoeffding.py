"""Split decision of an incremental tree, made by one aggregation over the whole table."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _entropy(positive: Column, total: Column) -> Column:
    def term(part: Column) -> Column:
        share = part.cast("double") / total
        return F.when(part > 0, -share * F.log2(share)).otherwise(F.lit(0.0))

    return term(positive) + term(total - positive)


def split_decision(
    df: DataFrame,
    bins: Mapping[str, Column],
    delta: float = 1e-7,
    tie_threshold: float = 0.05,
    label: str = "label",
) -> DataFrame:
    """Information gain per binned feature, and whether the best one may be split on.

    A split is taken if the gain of the best feature exceeds that of the second by the
    Hoeffding bound ``sqrt(R^2 ln(1/delta) / 2n)``, or if the bound is below the tie
    threshold; R is 1 for two classes.  The rows are reduced to (feature, bin) counts before
    any shuffle; what follows works on those few rows.
    """
    listed = F.array(
        *[F.struct(F.lit(name).alias("feature"), b.cast("bigint").alias("bin")) for name, b in bins.items()]
    )
    fake = (F.col(label) == "fake").cast("int").alias("_fake")
    counts = (
        df.where(F.col(label).isNotNull())
        .select(fake, F.inline(listed))
        .groupBy("feature", "bin")
        .agg(F.count(F.lit(1)).alias("_rows"), F.sum("_fake").alias("_fakes"))
    )
    inside = (F.col("_rows") * _entropy(F.col("_fakes"), F.col("_rows"))).alias("_inside")
    per_feature = counts.groupBy("feature").agg(
        F.sum("_rows").alias("n"), F.sum("_fakes").alias("_all_fakes"), F.sum(inside).alias("_within")
    )
    gains = per_feature.select(
        "feature",
        "n",
        (_entropy(F.col("_all_fakes"), F.col("n")) - F.col("_within") / F.col("n")).alias("gain"),
        F.sqrt(F.lit(math.log(1.0 / delta)) / (2.0 * F.col("n"))).alias("bound"),
    )
    # One row per feature.
    ranked = Window.orderBy(F.desc(F.round("gain", 9)), "feature")
    everything = Window.partitionBy()
    placed = gains.withColumn("place", F.row_number().over(ranked))
    best = F.max(F.when(F.col("place") == 1, F.col("gain"))).over(everything)
    second = F.coalesce(
        F.max(F.when(F.col("place") == 2, F.col("gain"))).over(everything), F.lit(0.0)
    )
    return placed.withColumn(
        "split",
        (F.col("place") == 1)
        & ((best - second > F.col("bound")) | (F.col("bound") < tie_threshold)),
    )
