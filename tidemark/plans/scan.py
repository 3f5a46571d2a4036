"""Exact positions and prefix sums over groups of any size.

A window without ``partitionBy``, or with one huge key, puts its whole group into one
task.  Here the rows are range-partitioned by (group, order), which splits such a
group over as many tasks as its size asks for; what crosses the cuts is one small row
per range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.staging import stage

#: Rows of one group which share a block, and so one window task.
BLOCK_ROWS = 50_000

#: Offsets are sent to all tasks up to this many rows (some 50 bytes each).
BROADCAST_ROWS = 500_000

_LOW_BITS = (1 << 33) - 1


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal ``keys`` where null equals null, keeping the left key columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def with_position(
    df: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    label: str = "ordered",
) -> DataFrame:
    """Add ``pos`` (0-based rank in the group) and ``group_rows`` (size of the group).

    ``order`` must be unique within the group.  One range exchange, one written table.
    The offsets hold one row per (group, range), so at most the number of shuffle
    partitions plus the number of groups.
    """
    keys = [*group, *order]
    slotted = (
        df.repartitionByRange(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    staged = stage(slotted, label).withColumns(
        {
            "_range": F.shiftrightunsigned("_slot", 33),
            "_within": F.col("_slot").bitwiseAND(F.lit(_LOW_BITS)),
        }
    )
    parts = staged.groupBy(*group, "_range").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_within").alias("_first")
    )
    parts = stage(parts, f"{label}-parts")
    # Without a group there is one row per range partition: few by construction.
    few = not group or parts.count() <= BROADCAST_ROWS
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *group,
        "_range",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_base"),
        F.sum("_rows").over(whole).alias("group_rows"),
    )
    joined = null_safe_join(
        staged, F.broadcast(offsets) if few else offsets, [*group, "_range"], "inner"
    )
    return joined.withColumn("pos", F.col("_within") + F.col("_base")).drop(
        "_slot", "_range", "_within", "_base"
    )


def block_of(pos: Column | str, block_rows: int) -> Column:
    return F.floor(F.col(pos) / block_rows) if isinstance(pos, str) else F.floor(pos / block_rows)


_FOLD = {
    "sum": (F.sum, lambda carry, here: F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def running(
    df: DataFrame,
    measures: Mapping[str, tuple[str, Column]],
    group: Sequence[str] = (),
    pos: str = "pos",
    inclusive: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running sum/min/max per group in ``pos`` order, blocked so no task holds a group.

    Group columns must not be null.  ``measures`` maps an output name to ("sum" | "min" | "max", expression).  The rows
    are shuffled once, by (group, block).  The carries (one row per group and block) come
    back through an equi-join on the same keys, which needs no second shuffle of the rows.
    """
    sources = {f"_in_{name}": expr for name, (_, expr) in measures.items()}
    blocked = df.withColumns({"_block": block_of(pos, block_rows), **sources})
    keys = [*group, "_block"]
    frame_end = 0 if inclusive else -1
    here = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, frame_end)
    totals = blocked.groupBy(*keys).agg(
        *[_FOLD[kind][0](f"_in_{name}").alias(f"_all_{name}") for name, (kind, _) in measures.items()]
    )
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *keys,
        *[
            _FOLD[kind][0](f"_all_{name}").over(earlier).alias(f"_carry_{name}")
            for name, (kind, _) in measures.items()
        ],
    )
    local = blocked.withColumns(
        {f"_here_{name}": _FOLD[kind][0](f"_in_{name}").over(here) for name, (kind, _) in measures.items()}
    ).drop(*sources)
    # Plain equality on the columns the rows are already partitioned and sorted by.
    joined = local.join(carries, keys, "left")
    folded = joined.withColumns(
        {
            name: _FOLD[kind][1](F.col(f"_carry_{name}"), F.col(f"_here_{name}"))
            for name, (kind, _) in measures.items()
        }
    )
    return folded.drop(
        "_block",
        *[f"_carry_{name}" for name in measures],
        *[f"_here_{name}" for name in measures],
    )


def with_halo(
    df: DataFrame,
    reach: int,
    pos: str = "pos",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Give each row to its block and, if a later block looks back at it, to that one too.

    Adds ``block`` and ``halo``.  A row is copied only when it lies in the last ``reach``
    rows of its block, so the copies are ``reach / block_rows`` of the input.
    """
    if reach > block_rows:
        raise ValueError("block_rows must be at least the look-back")
    own = block_of(pos, block_rows)
    mine = F.struct(own.alias("block"), F.lit(False).alias("halo"))
    next_one = F.struct((own + 1).alias("block"), F.lit(True).alias("halo"))
    copies = F.when(
        F.col(pos) % block_rows >= block_rows - reach, F.array(mine, next_one)
    ).otherwise(F.array(mine))
    return df.select("*", F.inline(copies))
