"""Small tables for the tests: awkward rows, and columns whose names clash with those of the operators."""

from pyspark.sql import functions as F

CLASHING = (
    "h", "w", "pos", "word", "gram", "marked", "leaf", "epochs", "epoch", "copies", "n", "rank", "fp", "root", "part",
    "mask", "score", "lang_pred", "spans", "start", "n_words", "n_tokens", "items", "tie", "spread", "n_bytes",
)

LONG = "Stone and water, token 4111 1111 1111 1111 near the old mill. " * 4000

ROWS = [
    (1, "One small text about the river and the mill.", "en", "src1"),
    (2, None, "en", "src1"),
    (3, "", None, "src2"),
    (4, "   \t\n ", "de", None),
    (5, "12345 %%% 67", "en", "src1"),
    (6, LONG, "en", "src0"),
    (7, "Grüße aus der Straße, schöne Wörter über Äpfel und Öl.", "de", "src2"),
    (7, "Grüße aus der Straße, schöne Wörter über Äpfel und Öl.", "de", "src2"),
    (None, "A text without a key, mail me at who@example.org please.", "en", "src1"),
    (None, None, None, None),
    (9, "One small text about the river and the mill.", "en", "src0"),
    (10, "\x00\x1c odd ﻿ \U0001f600 中文 é <|endoftext|>", "en", "src3"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


def documents(spark, rows=None):
    """The awkward rows, with columns of clashing names."""
    docs = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA).withColumn("n_chars", F.length("text").cast("bigint"))
    return docs.select("*", *(F.lit("x").alias(c) for c in CLASHING)).repartition(3)


def plain(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def by_key(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}
