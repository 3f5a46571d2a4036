"""Main text of web pages by the tree model of ``page_model``.

Training: a bounded set of ``PAGES`` labelled pages in many layouts; tasks count their
observations, one aggregation adds them up, and the counts (names of tags, classes and
buckets, a few hundred rows) make the model.  Own labelled pages, with ``data-main`` marks, can
be given instead.  Extraction is one pass without exchange.

Null or empty html: empty text.  Any string is read; unclosed and stray tags follow the usual
rules.  Scripts, styles, the head, hidden elements and form controls hold no text.  Repeated
rows and rows without key give a row each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.page_model import PageModel, labelled_page, observations

#: Labelled pages which are made for training.
PAGES = 3000


def labelled_pages(spark: SparkSession, pages: int = PAGES) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [labelled_page(n) for n in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["html"])

    return spark.range(pages).mapInArrow(make, "html string")


def train(labelled: DataFrame, html: str = "html") -> PageModel:
    """The model of labelled pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                counts.update(observations(page or ""))
        what, state = [w for w, _ in counts], [x for _, x in counts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(what, pa.string()), pa.array(state, pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["what", "state", "n"],
        )

    parts = labelled.select(html).mapInArrow(count, "what string, state int, n bigint")
    by_state = [F.sum(F.when(F.col("state") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in range(3)]
    sums = parts.groupBy("what").agg(*by_state)
    return PageModel({row.what: (row.n0, row.n1, row.n2) for row in sums.collect()})


def extract(pages: DataFrame, model: PageModel, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(page) if page else "" for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html")
    )
    return rows.mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint")
