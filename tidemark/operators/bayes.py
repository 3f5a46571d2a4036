"""Test-then-train Gaussian naive Bayes: every row is predicted from the rows before it.

The learner's state after any number of rows is a handful of sums per class, so the whole
sequential evaluation is a running aggregate, and it is done as one: no row is visited in a
loop.  This takes the part of the reference's incremental trees (same protocol, same role,
other scores).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.scan import BLOCK_ROWS, running
from tidemark.schemas import LABELS

VAR_FLOOR = 1e-9
_EXACT = "decimal(38,0)"


@dataclass(frozen=True)
class Candidate:
    """One setting of the learner: which inputs it uses and the least variance it assumes."""

    features: tuple[str, ...]
    var_floor: float = VAR_FLOOR


def _names(feature: str, label: str) -> tuple[str, str]:
    return f"_s_{feature}_{label}", f"_q_{feature}_{label}"


def class_statistics(
    df: DataFrame,
    features: Sequence[str],
    group: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add per class the count, sum and sum of squares of each feature over earlier rows.

    Features must be integers (scale them first).  Sums and squares are decimals of 38 digits,
    cast before they are multiplied: exact, whatever the split of the rows, and wide enough
    for the squares of any 64-bit integer.
    """
    measures: dict[str, tuple[str, Column]] = {}
    for label in LABELS:
        is_label = F.col("label") == label
        measures[f"_n_{label}"] = ("sum", F.when(is_label, F.lit(1).cast("bigint")))
        for f in features:
            s, q = _names(f, label)
            x = F.col(f).cast("bigint").cast("decimal(19,0)")
            measures[s] = ("sum", F.when(is_label, x).cast(_EXACT))
            measures[q] = ("sum", F.when(is_label, x * x).cast(_EXACT))
    return running(df, measures, group, inclusive=False, block_rows=block_rows)


def _variance(n: Column, s: Column, q: Column) -> Column:
    """Of ``n`` integers with sum ``s`` and sum of squares ``q``, without cancellation.

    Around a whole number ``m`` near the mean the squares add up to ``q - 2 m s + n m m``: exact
    in decimals, and small where the values lie together.
    """
    # no rows of the class yet: null, not a division by zero
    rows, count = n.cast("decimal(19,0)"), F.nullif(n.cast("double"), F.lit(0.0))
    m = F.floor(s.cast("double") / count).cast("decimal(19,0)")
    around = q - (s * m).cast(_EXACT) * 2 + ((rows * m).cast(_EXACT) * m).cast(_EXACT)
    rest = (s - (rows * m).cast(_EXACT)).cast("double") / count
    return around.cast("double") / count - rest * rest


def _log_score(label: str, candidate: Candidate) -> Column:
    # No rows of the class yet: everything that follows is null, not a division by zero.
    n = F.nullif(F.col(f"_n_{label}").cast("double"), F.lit(0.0))
    score = F.ln(n)
    for f in candidate.features:
        s, q = _names(f, label)
        mean = F.col(s).cast("double") / n
        var = F.greatest(_variance(F.col(f"_n_{label}"), F.col(s), F.col(q)), F.lit(candidate.var_floor))
        gap = F.col(f).cast("double") - mean
        score = score - F.lit(0.5) * F.ln(var) - gap * gap / (F.lit(2.0) * var)
    return score


def predicted(candidate: Candidate) -> Column:
    """The likelier class; ``nofake`` on a tie, or while a class has not been seen."""
    nofake, fake = LABELS
    seen = (F.col(f"_n_{nofake}") > 0) & (F.col(f"_n_{fake}") > 0)
    return F.when(
        seen & (_log_score(fake, candidate) > _log_score(nofake, candidate)), F.lit(fake)
    ).otherwise(F.lit(nofake))


def prequential(
    df: DataFrame,
    features: Sequence[str],
    group: Sequence[str] = (),
    keep: Sequence[str] = ("review_id", "pos"),
    block_rows: int = BLOCK_ROWS,
    var_floor: float = VAR_FLOOR,
) -> DataFrame:
    """Predictions ``y_pred`` next to the labels ``y`` for a stream with positions."""
    slim = df.select(*dict.fromkeys([*group, *keep, "pos", "label", *features]))
    stats = class_statistics(slim, features, group, block_rows)
    chosen = dict.fromkeys([*group, *keep])
    return stats.select(
        *chosen,
        F.col("label").alias("y"),
        predicted(Candidate(tuple(features), var_floor)).alias("y_pred"),
    )


def replay(
    df: DataFrame,
    candidates: Sequence[Candidate],
    group: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Accuracy of every candidate when the rows of a group are replayed test-then-train.

    The running sums do not depend on the candidate, so they are made once, and each row
    then votes once per candidate: the cost of a grid is arithmetic, not another pass.
    """
    features = list(dict.fromkeys(f for c in candidates for f in c.features))
    slim = df.select(*dict.fromkeys([*group, "pos", "label", *features]))
    stats = class_statistics(slim, features, group, block_rows)
    votes = stats.agg if not group else stats.groupBy(*group).agg
    totals = votes(
        F.count(F.lit(1)).alias("n"),
        *[
            F.sum((predicted(c) == F.col("label")).cast("int")).alias(f"_hits_{i}")
            for i, c in enumerate(candidates)
        ],
    )
    listed = F.array(
        *[
            F.struct(F.lit(i).alias("grid_pos"), F.col(f"_hits_{i}").cast("bigint").alias("hits"))
            for i in range(len(candidates))
        ]
    )
    return totals.select(*group, "n", F.inline(listed)).withColumn(
        "accuracy", F.col("hits").cast("double") / F.col("n")
    )


def best_candidate(scores: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """The candidate with the best accuracy; the earlier one wins a tie."""
    ranked = F.min_by(
        F.struct("grid_pos", "hits", "n", "accuracy"), F.struct(-F.col("hits"), "grid_pos")
    ).alias("best")
    picked = scores.groupBy(*group).agg(ranked) if group else scores.agg(ranked)
    return picked.select(*group, "best.*")
