"""Declared schemas and the column groups made from one list of measures."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_REVIEWS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("date", T.StringType()),
        T.StructField("review", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)

REVIEWS = T.StructType(
    [
        T.StructField("review_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("product_id", T.IntegerType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("cents", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("doc_id", T.LongType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

DRIFT_LOG = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("index", T.LongType()),
        T.StructField("acc_static", T.DoubleType()),
        T.StructField("acc_dynamic", T.DoubleType()),
        T.StructField("gap", T.DoubleType()),
        T.StructField("n_terms", T.IntegerType()),
        T.StructField("statistic", T.DoubleType()),
        T.StructField("p_value", T.DoubleType()),
        T.StructField("window_rows", T.IntegerType()),
        T.StructField("next_rows", T.IntegerType()),
        T.StructField("triggered", T.IntegerType()),
    ]
)

LABELS = ("nofake", "fake")

#: Numeric measures of a text, as produced by the text stage.
TEXT_MEASURES = (
    "pos_prop_adj",
    "pos_prop_adv",
    "char_counts",
    "angry",
    "fear",
    "happy",
    "sad",
    "surprise",
    "flesch_reading_ease",
    "pos_prop_intj",
    "mcalpine_eflaw",
    "polarity",
    "pos_prop_punct",
    "reading_time",
    "pos_prop_verb",
    "urls",
    "pos_prop_noun",
    "pos_prop_pron",
    "difficult_words_count",
)

#: The measures whose running mean is kept; the deviation is derived from two others.
RUNNING_MEASURES = ("rating", "word_count", *TEXT_MEASURES, "polarity_deviation")

#: Model inputs which belong to the review itself.
BASE_FEATURES = ("rating", "word_count", *TEXT_MEASURES)

#: Entity suffix -> key columns.
ENTITIES = {
    "user": ("user_id",),
    "product": ("product_id",),
    "rating": ("product_id", "rating"),
}

#: Activity columns, kept for the user only.
ACTIVITY = ("tweet_num", "was_spam", "week_num", "tweet_freq_week")


def running_columns(suffix: str, measures=RUNNING_MEASURES) -> list[str]:
    """Names of the running columns which one entity adds to the saved table."""
    names = [f"{m}_{kind}_{suffix}" for m in measures for kind in ("avg", "higher")]
    if "polarity_deviation" in measures:
        names.append(f"polarity_deviation_{suffix}")
    if suffix == "user":
        names += [f"{a}_{suffix}" for a in ACTIVITY]
    return names


def model_features() -> list[str]:
    """The 160 model inputs: 21 of the review, 49 of the user, 45 + 45 of the product."""
    return [*BASE_FEATURES, *[c for suffix in ENTITIES for c in running_columns(suffix)]]
