"""Running features of an entity: counts, fakes, means, flags and active weeks.

All rows are ordered by ``(ts, review_id)`` within their key.  A key of ordinary size is
one window group; a key above ``hot_rows`` goes through the blocked scan, so no task ever
holds a whole popular product.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import year_week
from tidemark.functions.labels import encode_label
from tidemark.functions.text_measures import polarity_deviation
from tidemark.operators.exact_sums import Grid, grids, limb_names, quoted, with_limbs, with_totals
from tidemark.plans import scan
from tidemark.plans.hot import HOT_ROWS, hot_keys
from tidemark.plans.staging import stage
from tidemark.schemas import ACTIVITY, ENTITIES, RUNNING_MEASURES

ORDER = ("ts", "review_id")

#: Stands for hot keys which have not been looked for yet.
SEARCH = "search"


def usable_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with every key present; a rating key must also be one of 1..5."""
    return df.where(usable(keys))


def usable(keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).isNotNull()
    if "rating" in keys:
        condition = condition & F.col("rating").isin(1, 2, 3, 4, 5)
    return condition


def _totals(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    hot: DataFrame | None,
    partition_by: Sequence[str],
    summands: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Add the running totals ``_n``, ``_fakes``, ``_weeks`` and a sum of each column of ``measures``.

    ``summands`` makes these columns; they are several times as wide as the rows, so they are made
    where the rows lie already.
    """
    if hot is None:
        return _windowed_totals(df, keys, measures, partition_by, summands)
    # Fewer than rows / hot_rows keys, so the list is small enough to send to all tasks.  The
    # input is read once, into a folder for each kind of key, and each way reads its own.
    listed = F.broadcast(hot.withColumn("_hot", F.lit(1)))
    marked = df.join(listed, list(keys), "left").select(*df.columns, F.coalesce("_hot", F.lit(0)).alias("_hot"))
    parted = stage(marked, "hot-and-usual", ["_hot"])
    usual = parted.where(F.col("_hot") == 0).select(*df.columns)
    large = parted.where(F.col("_hot") == 1).select(*df.columns)
    return _windowed_totals(usual, keys, measures, partition_by, summands).unionByName(
        _blocked_totals(large, keys, measures, summands)
    )


def _windowed_totals(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    partition_by: Sequence[str],
    summands: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    # One exchange for both windows: left to itself the planner would first shuffle by key
    # and week, and then again by key.
    per_week = Window.partitionBy(*keys, "_week").orderBy(*ORDER)
    by, order = (", ".join(map(quoted, columns)) for columns in (keys, ORDER))
    per_key = f"over (partition by {by} order by {order} rows between unbounded preceding and current row)"
    placed = df.repartition(*[F.col(k) for k in partition_by])
    flagged = placed.withColumn("_new_week", (F.row_number().over(per_week) == 1).cast("int"))
    kept = [quoted(c) for c in df.columns]
    return summands(flagged.sortWithinPartitions(*keys, *ORDER)).selectExpr(
        *kept,
        f"count(1) {per_key} as _n",
        f"sum(_fake) {per_key} as _fakes",
        f"sum(_new_week) {per_key} as _weeks",
        *[f"sum({quoted(m)}) {per_key} as {quoted(m)}" for m in measures],
    )


def _blocked_totals(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str], summands: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    placed = summands(scan.with_position(df, ORDER, keys, "hot-keys"))
    # One row per key and week: weeks are few, whatever the size of the key.
    weeks = placed.groupBy(*keys, "_week").agg(F.min("pos").alias("_first_pos"))
    flagged = placed.join(weeks, [*keys, "_week"])
    return scan.running(
        flagged,
        {
            "_fakes": ("sum", F.col("_fake")),
            "_weeks": ("sum", (F.col("pos") == F.col("_first_pos")).cast("int")),
            **{m: ("sum", F.col(m)) for m in measures},
        },
        keys,
    ).withColumn("_n", F.col("pos") + 1).drop("pos", "group_rows", "_first_pos")


def _was_spam(fakes: Column, label: Column) -> Column:
    # Two fakes, the current row included; a row without a label is never flagged.
    return F.when(label.isNotNull() & (fakes > 1), 1).otherwise(0)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    rows: int = HOT_ROWS,
    partition_by: Sequence[str] | None = None,
    hot: DataFrame | None | str = SEARCH,
    bits: Mapping[str, Grid] | None = None,
) -> DataFrame:
    """Rows with usable keys and their running totals ``_n``, ``_fakes``, ``_weeks``, ``_sum_<measure>``.

    ``hot`` as found by ``hot_keys``; ``bits`` as found by ``exact_sums.grids``.  Sums of
    fractions are exact and rounded once, so usual keys and hot keys end in equal bits.
    """
    own = usable_rows(df, keys)
    if isinstance(hot, str):
        hot = hot_keys(own, keys, rows)
    if bits is None:
        bits = grids(df, measures)
    whole = [f"{quoted(m)} as {quoted(f'_sum_{m}')}" for m in measures if m not in bits]
    prepared = own.withColumns({"_fake": encode_label("label"), "_week": year_week("ts")})

    def summands(rows: DataFrame) -> DataFrame:
        return with_limbs(rows.selectExpr("*", *whole), {f"_sum_{m}": (m, bits[m]) for m in measures if m in bits})

    summed = [p for m in measures for p in (limb_names(f"_sum_{m}", bits[m]) if m in bits else [f"_sum_{m}"])]
    totals = _totals(prepared, keys, summed, hot, partition_by or keys, summands)
    return with_totals(totals, {f"_sum_{m}": (f"_sum_{m}", bits[m]) for m in measures if m in bits})


def entity_features(
    df: DataFrame,
    keys: Sequence[str],
    suffix: str,
    measures: Sequence[str] = RUNNING_MEASURES,
    activity: bool = True,
    label_safe: bool = False,
    hot_rows: int = HOT_ROWS,
    partition_by: Sequence[str] | None = None,
    hot: DataFrame | None | str = SEARCH,
    bits: Mapping[str, Grid] | None = None,
) -> DataFrame:
    """Append the running columns of one entity.

    For each measure ``x``: ``x_avg_<suffix>`` is the running sum over the row number (a
    null or NaN ``x`` has a null mean and adds nothing, but its row counts) and
    ``x_higher_<suffix>`` says that ``x`` is not below that mean (true for a null ``x`` and
    for a NaN mean, which infinite values of both signs make).  ``activity`` adds the number of
    reviews, the spam flag, the number of active weeks and reviews per active week.
    ``label_safe`` adds ``was_spam_prior_<suffix>``, which looks at earlier rows only.

    ``partition_by`` names the keys to shuffle by, if fewer than all: with ``product_id`` the
    product x rating features reuse the exchange of the product features.
    ``polarity_deviation`` is derived from ``polarity`` and ``rating`` when it is asked for.
    """
    deviation = f"polarity_deviation_{suffix}"
    source = df
    if "polarity_deviation" in measures:
        source = df.withColumn("polarity_deviation", polarity_deviation("polarity", "rating"))
    if bits is None:
        bits = grids(source, measures)
    totals = running_totals(source, keys, measures, hot_rows, partition_by, hot, bits)
    means, flags = [], []
    for m in measures:
        x, total = quoted(m), quoted(f"_sum_{m}")
        mean, high = quoted(f"{m}_avg_{suffix}"), quoted(f"{m}_higher_{suffix}")
        usable = f"{x} is not null and not isnan({x})" if m in bits else f"{x} is not null"
        means.append(f"case when {usable} then cast({total} as double) / _n end as {mean}")
        # A mean exists where the measure does; no value is below a mean that is NaN.
        flags.append(f"coalesce(isnan({mean}) or {x} >= {mean}, true) as {high}")
    columns = {}
    if activity:
        columns[f"tweet_num_{suffix}"] = F.col("_n")
        columns[f"was_spam_{suffix}"] = _was_spam(F.col("_fakes"), F.col("_fake"))
        columns[f"week_num_{suffix}"] = F.col("_weeks")
        columns[f"tweet_freq_week_{suffix}"] = F.col("_n").cast("double") / F.col("_weeks")
    if label_safe:
        earlier = F.coalesce(F.col("_fakes"), F.lit(0)) - F.coalesce(F.col("_fake"), F.lit(0))
        columns[f"was_spam_prior_{suffix}"] = (earlier >= 1).cast("int")
    scratch = {"_fake", "_week", "_n", "_fakes", "_weeks", *(f"_sum_{m}" for m in measures)}
    kept = [quoted(c) for c in totals.columns if c not in scratch]
    pairs = [quoted(f"{m}_{kind}_{suffix}") for m in measures for kind in ("avg", "higher")]
    result = (
        totals.withColumns(columns)
        .selectExpr("*", *means)
        .selectExpr("*", *flags)
        .selectExpr(*kept, *pairs, *map(quoted, columns))
    )
    if "polarity_deviation" in measures:
        result = result.withColumnRenamed("polarity_deviation", deviation)
    return result


def incremental_features(
    df: DataFrame,
    measures: Sequence[str] = RUNNING_MEASURES,
    hot_rows: int = HOT_ROWS,
    only: str | None = None,
    table: DataFrame | None = None,
) -> DataFrame:
    """All three entities in turn; the activity columns are kept for the user only.

    Hot keys are looked for in ``df`` itself, which reads key columns only, and the ranges of its
    fractions once for all entities; give a table, or a staged one, and not the end of a long plan
    (or the same rows as such a ``table``).

    ``only``: a flag of the rows which are wanted.  All rows count, but the columns of the others are
    empty as soon as they are made, and these rows do not come out.
    """
    table = df if table is None else table
    source = table
    if "polarity_deviation" in measures:
        source = table.withColumn("polarity_deviation", polarity_deviation("polarity", "rating"))
    bits = grids(source, measures)
    hot = {s: hot_keys(usable_rows(table, keys), keys, hot_rows) for s, keys in ENTITIES.items()}
    out = df
    for suffix, keys in ENTITIES.items():
        given = out.columns
        out = entity_features(
            out, keys, suffix, measures, suffix == "user", partition_by=keys[:1], hot=hot[suffix], bits=bits
        )
        if only:
            out = out.select(*[F.col(quoted(c)) if c in given else F.when(F.col(only), F.col(quoted(c))).alias(c) for c in out.columns])
    return out.where(F.col(only)) if only else out


def running_variance(
    df: DataFrame, features: Sequence[str], group: Sequence[str] = (), block_rows: int = scan.BLOCK_ROWS
) -> DataFrame:
    """``keep_<f>``: fewer than two rows seen so far, or more than one value seen.

    ``df`` carries ``pos`` (see ``scan.with_position``).
    """
    measures = {}
    for f in features:
        measures[f"_min_{f}"] = ("min", F.col(f))
        measures[f"_max_{f}"] = ("max", F.col(f))
    scanned = scan.running(df, measures, group, block_rows=block_rows)
    return scanned.withColumns(
        {
            f"keep_{f}": (F.col("pos") < 1) | (F.col(f"_min_{f}") < F.col(f"_max_{f}"))
            for f in features
        }
    ).drop(*measures)


__all__ = [
    "ACTIVITY",
    "ORDER",
    "entity_features",
    "incremental_features",
    "running_totals",
    "running_variance",
    "usable",
    "usable_rows",
]
