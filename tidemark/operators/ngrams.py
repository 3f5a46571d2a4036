"""Vocabulary, sparse n-gram counts, window totals and the chi-square test on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.special import chi2_tail_column
from tidemark.functions.text import ngrams, tokens
from tidemark.plans.scan import null_safe_join, running
from tidemark.plans.staging import sized, stage

COLD_START = 500
MIN_DF, MAX_DF = 0.1, 0.7
MIN_COUNT = 6

#: Bytes of text whose terms a task counts: its table of counts is many times as large.
TASK_BYTES = 8 << 20


def _exploded(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    # The words are a column of their own, so that each text is cut into words once.
    words = df.select(*keys, tokens(text).alias("_words"))
    return words.select(*keys, F.explode(ngrams("_words")).alias("term"))


def dealt_texts(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """The texts by their keys, a bounded number of bytes a task: what is counted per key then stays there."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return df.select(*keys, text).repartition(parts, *keys)


def term_rows(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per key and different 1- or 2-gram, with its count.

    The texts are dealt by their keys, so the terms of a key are made where they are counted
    and never shuffled: they are many times the text.
    """
    exploded = _exploded(dealt_texts(df, keys, text), keys, text)
    return exploded.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("cnt"))


def vocabulary(
    df: DataFrame,
    text: str = "text",
    group: Sequence[str] = (),
    min_df: float = MIN_DF,
    max_df: float = MAX_DF,
) -> DataFrame:
    """Terms whose share of the given texts lies in [min_df, max_df], with ``df``.

    ``df`` holds the cold-start rows only.  A kept term is in at least ``min_df`` of them,
    so there are at most (terms per text) / min_df terms per group.  The result is a fitted
    model: it is written once and read by whatever counts with it.
    """
    # The empty term stands for the text itself, so its count is the number of texts.
    found = (
        # Few rows with much text: without this they could all lie in one task.
        df.repartition(df.sparkSession.sparkContext.defaultParallelism)
        .select(*group, tokens(text).alias("_words"))
        .select(*group, F.explode(F.array_union(ngrams("_words"), F.array(F.lit("")))).alias("term"))
        .groupBy(*group, "term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    found = stage(found, "cold-start-terms")
    # One row a group; the terms themselves are never gathered.
    texts = found.where(F.col("term") == "").select(*group, F.col("df").alias("_texts"))
    sized_up = null_safe_join(found, F.broadcast(texts) if not group else texts, group, "inner")
    kept = sized_up.where(
        (F.col("term") != "")
        & (F.col("df") >= F.col("_texts") * min_df)
        & (F.col("df") <= F.col("_texts") * max_df)
    ).drop("_texts")
    return stage(kept, "vocabulary")


def vocabulary_counts(
    df: DataFrame, vocab: DataFrame, keys: Sequence[str], text: str = "text", group: Sequence[str] = ()
) -> DataFrame:
    """Counts per text of the vocabulary's terms only (sparse: no zero rows)."""
    wanted = vocab.select(*group, "term")
    exploded = _exploded(df, list(dict.fromkeys([*group, *keys])), text)
    # Sent to all tasks if it is counted to be small, so that the n-grams stay where they are.
    kept = exploded.join(sized(wanted), [*group, "term"], "left_semi")
    return kept.groupBy(*dict.fromkeys([*group, *keys]), "term").agg(F.count(F.lit(1)).alias("cnt"))


def window_sums(counts: DataFrame, window_rows: int, pos: str = "pos") -> DataFrame:
    """Total count per term in consecutive windows of ``window_rows`` texts."""
    return counts.groupBy(
        F.floor(F.col(pos) / window_rows).alias("win"), "term"
    ).agg(F.sum("cnt").alias("total"))


def prefix_totals(
    counts: DataFrame, every: int, pos: str = "pos", block_rows: int = 100_000
) -> DataFrame:
    """Running total per term at every ``every``-th text in which the term occurred.

    The total of any window (lo, hi] is then P(hi) - P(lo).
    """
    steps = counts.groupBy("term", F.floor(F.col(pos) / every).alias("step")).agg(
        F.sum("cnt").alias("here")
    )
    return running(
        steps, {"prefix": ("sum", F.col("here"))}, ["term"], pos="step", block_rows=block_rows
    )


def chi_square(
    cells: DataFrame, a: Column | str, b: Column | str, keys: Sequence[str], min_count: int = MIN_COUNT
) -> DataFrame:
    """Test of homogeneity of two count vectors, per key.

    A term takes part if both counts are at least ``min_count``.  With one term, or none,
    p is 1; with two terms (one degree of freedom) the continuity correction is applied.
    ``cells`` has one row per key and term; the result has one row per key, with ``n_terms``,
    ``statistic``, ``dof`` and ``p_value``.
    """
    ca = F.col(a) if isinstance(a, str) else a
    cb = F.col(b) if isinstance(b, str) else b
    both = F.least(ca, cb) >= min_count
    used = cells.select(*keys, "term", F.when(both, ca).alias("_a"), F.when(both, cb).alias("_b"))
    sums = used.groupBy(*keys).agg(
        F.count("_a").alias("n_terms"), F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb")
    )
    a_, b_ = F.col("_a").cast("double"), F.col("_b").cast("double")
    ta, tb = F.col("_ta").cast("double"), F.col("_tb").cast("double")
    expected_a = (a_ + b_) * ta / (ta + tb)
    expected_b = (a_ + b_) * tb / (ta + tb)
    gap = F.abs(a_ - expected_a)
    corrected = F.when(F.col("n_terms") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    part = corrected * corrected / expected_a + corrected * corrected / expected_b
    tested = (
        used.join(sums, list(keys))
        .groupBy(*keys)
        .agg(
            F.first("n_terms").alias("n_terms"),
            F.coalesce(F.sum(part), F.lit(0.0)).alias("statistic"),
        )
        .withColumn("dof", F.greatest(F.col("n_terms") - 1, F.lit(0)))
    )
    return tested.withColumn("p_value", chi2_tail_column("statistic", F.col("dof").cast("double")))
