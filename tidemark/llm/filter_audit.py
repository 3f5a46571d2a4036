"""What text filters remove, alone and in every order: additive counts of failure masks.

One scan of the texts writes a narrow row per document: key, part, the mask of the filters it
fails, two 64-bit hashes of its text.  A counting Bloom filter over the hashes clears texts which
occur once; only possible repeats shuffle, as whole texts combined before the exchange, for the
smallest key of each text.  Flags and labels are joined to the narrow rows, which add up to
counts by (part, mask).  Every order and step is a sum over masks, so no order is run by itself.

Null texts are empty ones, null parts are "".  A null key is neither smaller nor larger than
another, so such a row repeats nothing and has no label.  Rows which repeat both key and text are
no repeats of each other and count one each.  Several labels of a key count as one which has any
of their marks.  An empty table gives no rows.  Other columns of either table are not looked at.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import UPPER
from tidemark.llm.repeat_sketch import MAX_SEGMENTS, possible_repeat
from tidemark.plans.staging import stage

#: White space of the word definition: a fixed value.
SPACES = r"[\x20\x09-\x0D]+"

#: The filter which looks at other rows.
REPEAT = "E"


def text_checks(text: Column) -> dict[str, Column]:
    """Filters of a single text: true where it fails."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    distinct = F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * distinct < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _mask(checks: Mapping[str, Column], letters: str) -> Column:
    mask = F.lit(0)
    for letter, fails in checks.items():
        mask = mask + F.when(fails, 1 << letters.index(letter)).otherwise(0)
    return mask.cast("int")


def first_keys(texts: DataFrame) -> DataFrame:
    """``first_id, h1, h2`` of each text of ``texts`` (``doc_id, text, h1, h2``): its smallest key."""
    smallest = texts.groupBy("text").agg(
        F.min("doc_id").alias("first_id"), F.first("h1").alias("first_h1"), F.first("h2").alias("first_h2")
    )
    return smallest.drop("text").filter(F.col("first_id").isNotNull())


def mask_counts(
    docs: DataFrame,
    labels: DataFrame,
    checks: Mapping[str, Column] | None = None,
    key: str = "doc_id",
    text: str = "text",
    part: str = "source",
    segments: int = MAX_SEGMENTS,
) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and set of failed filters.

    ``checks`` are columns over a column ``text``; bit i of the mask is the i-th letter, the last
    one that of repeated texts.  ``segments`` bounds the sketch.
    """
    checks = checks or text_checks(F.col("text"))
    letters = "".join(checks) + REPEAT
    whole = docs.select(
        F.col(key).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
    ).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(len(letters)), F.col("text"))})
    narrow = stage(whole.select("doc_id", "part", _mask(checks, letters).alias("mask"), "h1", "h2"), "filter-flags")
    repeats = possible_repeat(narrow.select("h1"), narrow.count(), segments)

    firsts = first_keys(whole.select("doc_id", "text", "h1", "h2").filter(repeats(F.col("h1"))))
    keyless = narrow.filter("doc_id IS NULL").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    keyed = (
        narrow.filter("doc_id IS NOT NULL")
        .withColumn("open", repeats(F.col("h1")))
        .groupBy("doc_id", "part", "mask", "open", "h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    same = (F.col("doc_id") == F.col("first_id")) & (F.col("h1") == F.col("first_h1")) & (F.col("h2") == F.col("first_h2"))
    marks = labels.groupBy(F.col(key).cast("bigint").alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic")
    )
    fails = F.col("open") & F.col("first_id").isNull()
    flagged = (
        keyed.join(firsts, same, "left")
        .join(marks, F.col("doc_id") == F.col("label_id"), "left")
        .select(
            "part",
            (F.col("mask") + F.when(fails, 1 << letters.index(REPEAT)).otherwise(0)).cast("int").alias("mask"),
            "n",
            (F.col("n") * F.coalesce("is_good", F.lit(0))).alias("good"),
            (F.col("n") * F.coalesce("is_toxic", F.lit(0))).alias("toxic"),
        )
    )
    none = F.lit(0).cast("bigint")
    every = flagged.unionByName(keyless.withColumns({"good": none, "toxic": none}))
    return every.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def _steps(letters: str) -> list[tuple[str, int, int, int]]:
    """Order, step, number of the step's filter, mask of the filters before it."""
    return [
        ("".join(order), i + 1, letters.index(letter), sum(1 << letters.index(x) for x in order[:i]))
        for order in permutations(letters)
        for i, letter in enumerate(order)
    ]


def _roles(size: int) -> list[tuple[int, ...]]:
    """What a mask adds to a filter after a set of others: kept, removed, redundant, unique; and to its Shapley sum."""
    orders = factorial(size)
    roles = []
    for mask in range(1 << size):
        for own in range(size):
            for before in (b for b in range(1 << size) if not b >> own & 1):
                fails, gone = mask >> own & 1, int(mask & before > 0)
                # Of the filters which a document fails, each comes first in as many orders.
                share = orders // mask.bit_count() if fails else 0
                roles.append((mask, own, before, (1 - fails) * (1 - gone), fails * (1 - gone), fails * gone, int(mask == 1 << own), share))
    return roles


def all_orders(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from ``mask_counts``.

    Both tables of roles and of steps hang on the number of filters alone: 2,560 and 600 rows for five.
    """
    spark = counts.sparkSession
    roles = spark.createDataFrame(
        _roles(len(letters)),
        "mask int, own int, before int, is_kept int, is_removed int, is_redundant int, is_unique int, share int",
    )
    steps = spark.createDataFrame(_steps(letters), "filter_order string, step int, own int, before int")

    def added(role: str, count: str = "n") -> Column:
        return F.sum(F.col(role) * F.col(count)).cast("bigint")

    summed = counts.join(F.broadcast(roles), "mask").groupBy("part", "own", "before").agg(
        added("is_kept").alias("kept"),
        added("is_removed").alias("removed"),
        added("is_redundant").alias("redundant"),
        added("is_unique").alias("unique_fails"),
        added("is_removed", "good").alias("good_lost"),
        added("is_removed", "toxic").alias("toxic_lost"),
        added("share").alias("shapley"),
    )
    return summed.join(F.broadcast(steps), ["own", "before"]).drop("own", "before")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order of the five filters A to E over ``docs``."""
    return all_orders(mask_counts(docs, labels), "".join(text_checks(F.col("text"))) + REPEAT)
