"""Row and column selection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rating_class(df: DataFrame, mode: int) -> DataFrame:
    """Mode 4 keeps ratings below 5, mode 5 keeps ratings of exactly 5."""
    if mode == 4:
        return df.where(F.col("rating") < 5)
    if mode == 5:
        return df.where(F.col("rating") == 5)
    raise ValueError("mode must be 4 or 5")


def of_entity(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows whose key columns equal all the given values."""
    for column, value in values.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def row_range(df: DataFrame, low: int, high: int, pos: str = "pos") -> DataFrame:
    """Rows at positions ``low`` up to but not including ``high``."""
    return df.where((F.col(pos) >= low) & (F.col(pos) < high))


def first_rows(df: DataFrame, n: int, order: Sequence[str] = ("ts", "review_id")) -> DataFrame:
    """The first ``n`` rows in order; each task keeps only its own best ``n``."""
    return df.orderBy(*order).limit(n)


def fill_missing(df: DataFrame, text_columns: Iterable[str]) -> DataFrame:
    """Empty text for missing texts, 0 for missing numbers and flags."""
    texts = list(text_columns)
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    filled = df.na.fill("", texts).na.fill(0)
    return filled.na.fill(False, flags) if flags else filled


def matching_columns(df: DataFrame, part: str) -> list[str]:
    """Names of the columns which contain ``part``."""
    return [c for c in df.columns if part in c]


def select_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The chosen columns as numbers; flags become 0 and 1."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features])


def varying_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature: does it take more than one value (or has it under two rows)?"""
    spread = df.agg(
        *[
            F.coalesce(
                (F.count(F.lit(1)) < 2) | (F.min(f) < F.max(f)), F.lit(False)
            ).alias(f)
            for f in features
        ]
    )
    pairs = ", ".join(f"'{f}', `{f}`" for f in features)
    return spread.selectExpr(f"stack({len(features)}, {pairs}) as (feature, kept)")
