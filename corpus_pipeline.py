"""From documents to token shards: language, near-duplicates, benchmark passages, mixture, ids.

Each stage takes what the stage before it kept, as written Parquet, and decides over all of it.

Null texts are empty ones; null keys equal each other and stay where no other key is.  Rows which
repeat key and text are copies: one stays.  An empty table gives an empty result.  Further columns
are carried along; names which begin with two underscores are the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.decontaminate import contamination
from tidemark.llm.lang_id import UNKNOWN, held_out_fold, identify, learn_profiles
from tidemark.llm.mixing import mixed_documents, selection
from tidemark.llm.pretokens import vocabulary_path
from tidemark.llm.queries import mixture_path, mixture_weight
from tidemark.llm.simhash import deduplicated
from tidemark.llm.token_shards import shard_documents
from tidemark.plans.staging import stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be learned, under the language found.

    Texts without letters go, and those without any n-gram of any profile, whose score is 0.
    Where no row has a label there is nothing to learn, so the others stay as they are.
    """
    profiles = learn_profiles(docs.filter(~held_out_fold(F.col("doc_id"))))
    if not profiles:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    named = identify(docs, profiles, names=("__lang", "__score")).filter((F.col("__lang") != UNKNOWN) & (F.col("__score") > 0))
    return named.withColumn("lang", F.col("__lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of three-word shingles two bits apart or less, that with the smallest key."""
    return deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in benchmark windows."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    out = found.select(F.col("doc_id").alias("__key"), F.col("h").alias("__h")).distinct()
    marked = docs.withColumn("__hash", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    same = F.col("doc_id").eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__h"))
    return marked.join(out, same, "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of all tokens at the target weights; a document stands once for each of its epochs.

    The last document of a leaf is cut after the words which its budget still holds.
    """
    mixed = mixed_documents(docs, selection(docs, mixture_path(), mixture_weight, cut=True), mixture_path())
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else mixed


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids, and where each document stands in them."""
    return shard_documents(docs, vocabulary_path())


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mixture),
    ("token-ID output", token_ids),
]

#: Language profiles, fingerprints and token ids cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
