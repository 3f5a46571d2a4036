"""SimHash fingerprints, and the groups of documents which they link.

Fingerprints are made per document in numpy.  Only distinct fingerprints go on, each with its
smallest key, so thousands of copies are one row.  Two fingerprints at most ``RADIUS`` = 2 bits
apart agree on two of the four 16-bit blocks, so each is dealt to the six buckets of its pairs
of blocks.  A bucket beyond ``BUCKET`` rows is dealt again by pairs of blocks of the bits
which it has not fixed (8, then 4, then 2 bits wide; 60 bits at last, so at most 16 rows remain): no bucket grows with
the data and no link is lost.  Within a bucket a Gray-order index finds the links and hands on
a spanning forest; star contraction joins the forests.

Null text: no words, fingerprint zero, linked like any other.  Null keys get a component by
the other members' keys, null if the group has none.  Repeated rows give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import LOWER, UPPER, keyed_text
from tidemark.llm.components import components
from tidemark.llm.gray_index import spanning_links
from tidemark.plans.staging import stage

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Distinct fingerprints which one index may hold.
BUCKET = 4096
_CASE = str.maketrans(UPPER, LOWER)
_HASHES = 1 << 15  # hashes whose bits are counted at once


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit is 1 if it is set in over half the hashes of the word shingles, repeats included."""
    # ASCII letters and white space are the same bytes in UTF-8, and bytes know no other case or space
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = xxhash.xxh64_intdigest
    parts = zip(*(words[k:] for k in range(shingle)), strict=False)
    hashes = np.array([digest(p, seed) for p in map(b" ".join, parts)], np.uint64)
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), _HASHES):
        part = hashes[low : low + _HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of each row, 64 bits as a signed integer, as column ``name``."""
    kept = docs.drop(name)
    at = kept.columns.index(text)
    schema = StructType([*kept.schema.fields, StructField(name, LongType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t or "", shingle) for t in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.view(np.int64))], names=schema.names)

    return kept.mapInArrow(make, schema)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def finer(masks: dict[int, list[tuple[int, int]]]) -> tuple[list[tuple[int, int]], dict[int, list[tuple[int, int]]]]:
    """Six finer masks for each mask, and the runs of bits (low, width) which each leaves free.

    The free bits are cut into four blocks; a finer mask fixes two of them.
    """
    steps, left = [], {}
    for mask, free in masks.items():
        parts = 4 // len(free)
        blocks = [(low + k * width // parts, width // parts) for low, width in free for k in range(parts)]
        for i in range(4):
            for j in range(i + 1, 4):
                fixed = mask
                for k in (i, j):
                    fixed |= ((1 << blocks[k][1]) - 1) << blocks[k][0]
                steps.append((_signed(mask), _signed(fixed)))
                left.setdefault(fixed, [b for k, b in enumerate(blocks) if k not in (i, j)])
    return steps, left


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal (mask, part); a run may go on in the next batch."""
    held: list[np.ndarray] = []
    name = None
    for batch in batches:
        masks, parts, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = np.flatnonzero((masks[1:] != masks[:-1]) | (parts[1:] != parts[:-1])) + 1
        starts, ends = np.concatenate([[0], cuts]), np.append(cuts, len(own))
        # the first run may belong to the batch before, the last one to the next
        for k in np.unique(np.concatenate([[0], np.flatnonzero(ends - starts > 1), [len(starts) - 1]])):
            low, high = starts[k], ends[k]
            if low == high:
                continue
            if name != (masks[low], parts[low]):
                yield from _linked(held)
                held, name = [], (masks[low], parts[low])
            held.append(own[low:high])
    yield from _linked(held)


def _linked(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    members = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
    if len(members) > 1:
        u, v = spanning_links(members.view(np.uint64), RADIUS)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``u, v``: links which join the same groups as all pairs of ``fp`` at most two bits apart."""
    spark = distinct.sparkSession
    steps, masks = finer({0: [(0, 64)]})
    ways = F.explode(F.array(*(F.lit(m).cast("bigint") for _, m in steps)))
    dealt = distinct.select("fp", ways.alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")
    found = None
    for level in range(4):
        # the last level leaves four bits free, so its buckets hold 16 fingerprints at most
        counts = dealt.groupBy("mask", "part").agg(F.count("*").alias("n")).filter(F.col("n") > bucket)
        full = stage(counts.select("mask", "part"), "full-buckets") if level < 3 else None
        some = full is not None and not full.isEmpty()
        usual = dealt.join(full, ["mask", "part"], "left_anti") if some else dealt
        placed = usual.repartition("mask", "part").sortWithinPartitions("mask", "part")
        made = placed.mapInArrow(_search, "u bigint, v bigint")
        found = made if found is None else found.unionByName(made)
        if not some:
            break
        steps, masks = finer(masks)
        look_up = F.broadcast(spark.createDataFrame(sorted(set(steps)), "mask bigint, next bigint"))
        deeper = dealt.join(full, ["mask", "part"], "left_semi").join(look_up, "mask")
        dealt = stage(
            deeper.select(F.col("next").alias("mask"), F.col("fp").bitwiseAND(F.col("next")).alias("part"), "fp").distinct(),
            "dealt-again",
        )
    return found


def groups(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``fp, root, component_id`` of each distinct fingerprint of ``rows`` (a written table).

    ``root`` names the group by one of its fingerprints, ``component_id`` by its smallest key.
    """
    classes = stage(rows.groupBy("fp").agg(F.min(key).alias("first")), "classes")
    joined = stage(components(links(classes.select("fp"))), "components")
    roots = joined.select(F.col("root").alias("node"), "root").distinct()
    members = joined.unionByName(roots).withColumnRenamed("node", "fp")
    ids = members.join(classes, "fp").groupBy("root").agg(F.min("first").alias("id"))
    named = members.join(ids, "root")
    every = classes.join(named, "fp", "left")
    alone = F.col("root").isNull()
    named = every.select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(alone, F.col("first")).otherwise(F.col("id")).alias("component_id")
    )
    # a written table, so that a join of all rows with it can be split at fingerprints with very many rows
    return stage(named, "groups")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` of each row of ``docs``."""
    rows = stage(with_fingerprints(keyed_text(docs, key, text)).select("doc_id", "fp"), "fingerprints")
    named = rows.join(groups(rows).select("fp", "component_id"), "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: that with the group's smallest key, of equal ones any."""
    mark = "__fp"  # carried beside the columns of ``docs``
    rows = stage(with_fingerprints(docs, text, name=mark), "marked")
    found = groups(rows.select(F.col(mark).alias("fp"), F.col(key).alias("doc_id")))
    best = found.select(F.col("fp").alias(mark), F.col("root").alias("__root"), F.col("component_id").alias("__id"))
    kept = rows.join(best, mark).filter(F.col(key).eqNullSafe(F.col("__id"))).dropDuplicates(["__root"])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
