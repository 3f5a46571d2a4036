"""Token counts per document: a table of frequent pieces for all tasks, worker caches beyond it.

First pass: every task counts the pieces (strings between white space, lower-cased) of all
its texts and hands on its most frequent ones, ``KEEP`` rows at most; these summaries, not
the pieces, are added up, and the ``TABLE_PIECES`` most frequent get their lengths from the
tokenizer once.  Pieces of over ``LONGEST_PIECE`` characters are in no table.  Second pass: that table (of bounded size, so it may be broadcast) fills the
first tier of each worker; misses are encoded once per worker and kept in its own cache.
The table changes the speed only: every count is the tokenizer's.

Null text: empty, no tokens.  Empty tables give empty results.  Repeated rows are counted
row by row, null keys stay null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keyed_text
from tidemark.llm.pretokens import LONGEST_PIECE, encoder

#: Rows which a task hands on, pieces which it counts at once, and entries of the broadcast table.
KEEP, COUNTED, TABLE_PIECES = 4096, 400_000, 32_768


def frequent_lengths(docs: DataFrame, path: str, entries: int = TABLE_PIECES) -> dict[str, int]:
    """Token lengths of the most frequent pieces, ``entries`` at most."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = encoder(path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if own.is_plain(text):
                    counts.update([p for p in text.lower().split() if len(p) <= LONGEST_PIECE])
                    if len(counts) > COUNTED:
                        counts = Counter(dict(counts.most_common(COUNTED // 4)))
        top = counts.most_common(KEEP)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
            names=["piece", "n"],
        )

    parts = docs.select("text").mapInArrow(summarise, "piece string, n bigint")
    ranked = parts.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece")
    own = encoder(path)
    return {row.piece: own.count(row.piece) for row in ranked.limit(entries).collect()}


def token_counts(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs``."""
    rows = keyed_text(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(rows, path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = encoder(path), shared.value
        if not table.keys() <= own.counts.keys():
            own.counts.update(table)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            tokens = [own.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    counted = rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
