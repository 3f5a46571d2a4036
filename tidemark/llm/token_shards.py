"""Token ids in shards with keyed access.

Layout: a Parquet table of shards, one row each, so that any store which Spark reaches holds
it, and a lost task is written again by Spark's own commit rules.  A shard has

* ``part, seq``: range of keys, and number within the range; ids of a shard follow those of
  the shard before it in this order, ``before`` counts the ids of the same part before it;
* ``payload``: the raw ids, little-endian, ``width`` bytes each, document after document;
* ``offsets``: 64-bit start of each document in the payload, in ids, and the end;
* ``keys``: the 64-bit keys in order, the first ``n_null`` of them null;
* ``moves, marks, entries``: a minimal perfect hash of the distinct keys: displacements,
  fingerprints, and position of the first document of a key for each slot.

Documents stand in ascending key order, nulls first; rows of one key follow each other by a
hash of their text, so a key with any number of rows may lie in several shards.  Each document
ends with ``end_id``; a null or empty text is that id alone.  An empty table gives no shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import perfect_hash
from tidemark.llm.common import keyed_text
from tidemark.llm.pretokens import encoder
from tidemark.plans.staging import new_path

#: A shard is closed at so many ids or documents.
SHARD_IDS, SHARD_DOCS = 1_000_000, 65_536

SHARDS = pa.schema(
    [
        ("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()),
        ("n_docs", pa.int32()), ("n_null", pa.int32()), ("low", pa.int64()), ("high", pa.int64()),
        ("width", pa.int32()), ("keys", pa.binary()), ("offsets", pa.binary()), ("payload", pa.binary()),
        ("moves", pa.binary()), ("marks", pa.binary()), ("entries", pa.binary()),
    ]
)
_DDL = (
    "part int, seq int, before bigint, n_ids bigint, n_docs int, n_null int, low bigint, high bigint, "
    "width int, keys binary, offsets binary, payload binary, moves binary, marks binary, entries binary"
)


def _shard(part: int, seq: int, before: int, width: int, keys: list, ids: list[bytes]) -> pa.RecordBatch:
    n_null = sum(k is None for k in keys)
    whole = np.array([0 if k is None else k for k in keys], "<i8")
    distinct, first = np.unique(whole[n_null:], return_index=True)
    moves, place = perfect_hash.build(distinct.view(np.uint64))
    marks = perfect_hash.fingerprints(distinct.view(np.uint64))[place]
    offsets = np.concatenate([[0], np.cumsum([len(x) // width for x in ids])]).astype("<i8")
    known = whole[n_null:]
    low, high = (int(known[0]), int(known[-1])) if len(known) else (None, None)
    row = (
        part, seq, before, int(offsets[-1]), len(keys), n_null, low, high, width, whole.tobytes(), offsets.tobytes(),
        b"".join(ids), moves.tobytes(), marks.astype("<u4").tobytes(), (first[place] + n_null).astype("<i4").tobytes(),
    )
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SHARDS, strict=True)], schema=SHARDS)


def write_shards(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, key: str = "doc_id", text: str = "text"
) -> None:
    """Encode every text and write the shards to ``path``: one exchange of the texts, by ranges of keys."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(vocabulary), TaskContext.get().partitionId()
        width, end = own.dtype.itemsize, np.array([end_id], own.dtype).tobytes()
        keys, ids, held, seq, before = [], [], 0, 0, 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(k)
                ids.append(own.encode(t) + end)
                held += len(ids[-1]) // width
                if held >= SHARD_IDS or len(keys) >= SHARD_DOCS:
                    yield _shard(part, seq, before, width, keys, ids)
                    keys, ids, seq, before, held = [], [], seq + 1, before + held, 0
        if keys:
            yield _shard(part, seq, before, width, keys, ids)

    rows = keyed_text(docs, key, text).withColumn("tie", F.xxhash64("text"))
    # the last column only spreads equal rows over ranges
    spread = rows.withColumn("spread", F.monotonically_increasing_id())
    placed = spread.repartitionByRange(*(F.asc_nulls_first(c) for c in ("doc_id", "tie", "spread")))
    ordered = placed.sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "spread").select("doc_id", "text")
    ordered.mapInArrow(encode, _DDL).write.option("compression", "zstd").parquet(path)


def part_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each range of keys: one number a range, as many as the exchange had partitions."""
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    starts, start = {}, 0
    for row in sorted(totals, key=lambda r: r.part):
        starts[row.part], start = start, start + row.n
    return starts


def _opened(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(
        np.frombuffer(row[c], kind)
        for c, kind in (
            ("keys", "<i8"), ("offsets", "<i8"), ("payload", f"<u{row['width']}"), ("moves", "<i4"), ("marks", "<u4"),
            ("entries", "<i4"),
        )
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each stored document, fetched through the index.

    Keyed documents are found by their key (then their repeats, which stand behind the first);
    documents without key are read by position.
    """
    starts = part_starts(spark, path)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                keys, offsets, payload, moves, marks, entries = _opened(row)
                n_null, base = row["n_null"], starts[row["part"]] + row["before"]
                at = np.arange(len(keys))
                known = keys[n_null:]
                slots = perfect_hash.look_up(known.view(np.uint64), moves, marks)
                if (slots < 0).any():
                    raise ValueError(f"shard {row['part']}/{row['seq']}: a key is not in its own index")
                first = entries[slots].astype(np.int64)
                repeat = np.arange(len(known)) - np.searchsorted(known, known)
                at[n_null:] = first + repeat
                sums = [zlib.crc32(payload[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None] * n_null + known.tolist(), pa.int64()),
                        pa.array(base + offsets[at], pa.int64()),
                        pa.array(offsets[at + 1] - offsets[at], pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return spark.read.parquet(path).mapInArrow(fetch, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def look_up(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """``doc_id, ids`` of a stated list of keys; only shards whose range holds one of them are read."""
    wanted = sorted(set(keys))
    parts = spark.read.parquet(path)
    near = F.exists(
        F.lit(np.array(wanted, np.int64)) if wanted else F.array().cast("array<bigint>"),
        lambda k: k.between(F.col("low"), F.col("high")),
    )
    reachable = parts.filter(F.col("low") <= (wanted[-1] if wanted else 0)).filter(
        F.col("high") >= (wanted[0] if wanted else 0)
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.array(wanted, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                stored, offsets, payload, moves, marks, entries = _opened(row)
                slots = perfect_hash.look_up(asked.view(np.uint64), moves, marks)
                names, found = [], []
                for key, slot in zip(asked.tolist(), slots.tolist(), strict=True):
                    at = int(entries[slot]) if slot >= 0 else len(stored)
                    while at < len(stored) and stored[at] == key and slot >= 0:
                        names.append(key)
                        found.append(payload[offsets[at] : offsets[at + 1]].tolist())
                        at += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "ids"]
                )

    return reachable.filter(near).mapInArrow(fetch, "doc_id bigint, ids array<bigint>")


def shard_documents(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the shards (to a new folder beside the checkpoints, if none is named) and read them back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-shards")
    write_shards(docs, path, vocabulary, end_id)
    return read_index(spark, path)
