"""Exact undersampling and contiguous time shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.scan import with_position
from tidemark.plans.staging import sized, stage

#: Buckets of the draw: four hexadecimal digits.
_DIGITS = 4


def draw_key(id_column: str, seed: int) -> Column:
    """A repeatable pseudo-random order of the rows."""
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f"#{seed}")))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def undersample(
    df: DataFrame,
    strata: Sequence[str],
    label: str = "label",
    id_column: str = "review_id",
    seed: int = 1,
) -> DataFrame:
    """Cut every class of a stratum to its smallest class, drawn without replacement.

    A stratum which holds one class only cannot be balanced and is dropped.
    Keeps the rows with the smallest ``md5(id#seed)``.  No class is ever sorted: a count per
    leading digits tells in which bucket each class is cut, only that bucket (a 65,536th of
    the class) is ranked, and the row found there is the limit which all rows are compared
    with.  The limits are one row per stratum and class.
    """
    limits = class_limits(df, strata, label, id_column, seed)
    return with_drawn(df, limits, strata, label, id_column, seed).where("_drawn").select(*df.columns)


def class_limits(
    df: DataFrame, strata: Sequence[str], label: str = "label", id_column: str = "review_id", seed: int = 1
) -> DataFrame:
    """The last row of each class which ``undersample`` keeps; no rows for a stratum of one class."""
    keys = [*strata, label]
    drawn = df.where(F.col(label).isNotNull()).withColumn("_draw", draw_key(id_column, seed))
    bucketed = drawn.select(*keys, id_column, "_draw", F.substring("_draw", 1, _DIGITS).alias("_bucket"))
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))

    per_class = Window.partitionBy(*keys)
    per_stratum = Window.partitionBy(*strata)
    upto = per_class.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    cut = stage(
        counts.withColumns(
            {"_class_rows": F.sum("_rows").over(per_class), "_upto": F.sum("_rows").over(upto)}
        )
        .withColumns(
            {
                "_target": F.min("_class_rows").over(per_stratum),
                "_one_class": F.min(label).over(per_stratum) == F.max(label).over(per_stratum),
            }
        )
        .where(~F.col("_one_class"))
        .where((F.col("_upto") >= F.col("_target")) & (F.col("_upto") - F.col("_rows") < F.col("_target")))
        .select(*keys, "_bucket", (F.col("_target") - (F.col("_upto") - F.col("_rows"))).alias("_take")),
        "cut-buckets",
    )
    ranked = Window.partitionBy(*keys).orderBy("_draw", id_column)
    return stage(
        # One cut bucket per stratum and class; strata are the caller's, so they are counted.
        bucketed.join(sized(cut), [*keys, "_bucket"])
        .withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") == F.col("_take"))
        .select(*keys, F.col("_draw").alias("_last_draw"), F.col(id_column).alias("_last_id")),
        "class-limits",
    )


def with_drawn(
    df: DataFrame, limits: DataFrame, strata: Sequence[str], label: str = "label", id_column: str = "review_id", seed: int = 1
) -> DataFrame:
    """Add ``_drawn``: whether ``undersample`` keeps the row, by the limits of its classes."""
    within = (F.col("_draw") < F.col("_last_draw")) | (
        (F.col("_draw") == F.col("_last_draw")) & (F.col(id_column) <= F.col("_last_id"))
    )
    drawn = df.withColumn("_draw", draw_key(id_column, seed)).join(sized(limits), [*strata, label], "left")
    return drawn.select(*df.columns, F.coalesce(within, F.lit(False)).alias("_drawn"))


def with_five(df: DataFrame) -> DataFrame:
    """The strata of ``balanced_union``: ``_five``, five-star reviews and all others."""
    return df.withColumn("_five", F.col("rating") == 5)


def balanced_union(df: DataFrame, seed: int = 1) -> DataFrame:
    """Five-star reviews and all others, balanced apart and put together, in one pass."""
    five = with_five(df).where(F.col("_five").isNotNull())
    return undersample(five, ["_five"], seed=seed).drop("_five")


def shard_number(pos: Column, total: Column, shards: int) -> Column:
    """Shard of a 0-based position: contiguous, near equal, the first ones larger by one."""
    small = F.floor(total / shards)
    larger = total % shards
    edge = larger * (small + 1)
    return (
        F.when(pos < edge, F.floor(pos / (small + 1)))
        .otherwise(larger + F.floor((pos - edge) / F.greatest(small, F.lit(1))))
        .cast("bigint")
    )


def split_shards(
    df: DataFrame, shards: int = 20, order: Sequence[str] = ("ts", "review_id")
) -> DataFrame:
    """Add ``shard`` and ``pos`` (position inside the shard)."""
    placed = with_position(df, order, label="shards")
    total, pos = F.col("group_rows"), F.col("pos")
    small, larger = F.floor(total / shards), total % shards
    start = F.col("shard") * small + F.least(F.col("shard"), larger)
    return (
        placed.withColumn("shard", shard_number(pos, total, shards))
        .withColumn("pos", (pos - start).cast("bigint"))
        .drop("group_rows")
    )
