"""Inputs which several queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text_measures as M
from tidemark.plans.scan import with_position
from tidemark.sources.reviews import reviews, table, texts

__all__ = [
    "DOC_MEASURES", "FEW_SHARDS", "GRAMS", "REVIEWS", "STREAM", "STUMP", "document_places",
    "few_shards_sql", "measured_reviews", "reviews", "stream", "stump_predictions", "table",
    "texts", "with_ctes",
]

#: Shards in the drift queries: few, so that a shard outlasts the cold start at small scale.
FEW_SHARDS = 4


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """The reviews as one ordered stream with ``pos``."""
    return with_position(reviews(spark, folder), ["ts", "review_id"], label="stream")


def document_places(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, pos``: ids alone are numbered, texts stay where they are."""
    ids = table(spark, folder, "documents").select("doc_id")
    return with_position(ids, ["doc_id"], label="documents").drop("group_rows")


def measured_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews with two integer measures of their text."""
    docs = texts(spark, folder, "documents").select(
        "doc_id", M.word_count("text").alias("word_count"), M.char_count("text").alias("char_counts")
    )
    return reviews(spark, folder).join(docs, "doc_id")


def stump_predictions(df: DataFrame, *keep: str) -> DataFrame:
    """Predictions of a one-level rule; none is offered for product 0."""
    predicted = F.when(F.col("product_id") != 0, F.when(F.col("cents") >= 1500, "fake").otherwise("nofake"))
    return df.select(*keep, F.col("label").alias("y"), predicted.alias("y_pred"))


REVIEWS = """reviews as (
  select event_id as review_id, user_id,
         cast(json_extract_string(props, '$.k') as integer) as product_id,
         cast(1 + (event_id * 7 + user_id) % 5 as integer) as rating, ts,
         cast(round(value * 100) as bigint) as cents,
         case when event_type = 'error' then 'fake' else 'nofake' end as label,
         event_id % (select count(*) from documents) as doc_id
  from events)"""

# Positions are running counts: DuckDB 2.0.0 drops a row when an upper bound is put on
# ``row_number() - 1`` of a materialised CTE.
STREAM = REVIEWS + """,
stream as (
  select *, count(*) over (order by ts, review_id rows unbounded preceding) - 1 as pos from reviews)"""

STUMP = """case when product_id = 0 or cents < 1500 then 'nofake' else 'fake' end"""

DOC_MEASURES = REVIEWS + r""",
measured as (
  select r.*, d.word_count, d.char_counts
  from reviews r join (
    select doc_id, len(regexp_extract_all(text, '[^\t-\r\x{1c}-\x{1f} \x{85}\p{Z}]+')) as word_count,
           length(text) as char_counts
    from documents) d using (doc_id))"""

#: Count per document and 1- or 2-gram.
GRAMS = r"""toks as (
  select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') as t from documents),
grams as (
  select doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) as term
  from toks),
counts as (select doc_id, term, count(*) as cnt from grams group by all)"""


def few_shards_sql(shards: int = FEW_SHARDS) -> str:
    """``sharded``: the stream with ``shard`` and the position inside it."""
    return STREAM + f""",
tiled as (
  select * exclude (pos), ntile({shards}) over (order by ts, review_id) - 1 as shard from stream),
sharded as (
  select *, count(*) over (partition by shard order by ts, review_id rows unbounded preceding) - 1 as pos from tiled)"""


def with_ctes(*parts: str, select: str) -> str:
    return "with " + ",\n".join(parts) + "\n" + select
