"""A counting Bloom filter over text hashes, which clears texts that occur once.

Every task counts the slots of its own hashes and hands on its non-empty slots, in segments of
``SEGMENT`` slots; segments are added up apart from each other, so no task holds a whole sketch
of the build.  What the look-up needs is one bit a slot (counted twice or more): ``SLOTS`` bits a
hash and ``MAX_SEGMENTS`` segments at most, 256 MB, which bounds the broadcast.  Beyond some 130
million hashes slots fill up and more unique texts pass as possible repeats: that costs a
shuffle of more texts, never a wrong answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of a segment, slots and probes for each hash, most segments.
SEGMENT, SLOTS, PROBES, MAX_SEGMENTS = 1 << 16, 16, 3, 1 << 15

#: Slots which a task gathers before it hands them on.
GATHERED = 1 << 20

_PART = "segment int, slots binary, counts binary"


def segments_for(hashes: int, most: int = MAX_SEGMENTS) -> int:
    return max(1, min(most, -(-hashes * SLOTS // SEGMENT)))


def slots_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """One row of slots for each probe."""
    bits = hashes.astype(np.int64).view(np.uint64)
    low, high = bits & np.uint64(0xFFFFFFFF), (bits >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)[:, None]
    return (low + steps * high) % np.uint64(segments * SEGMENT)


def _parts(slots: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Slots in ascending order, cut where a new segment begins; counters stop at 255."""
    owner = slots // SEGMENT
    cuts = np.flatnonzero(np.diff(owner)) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(slots)]
    inner, few = (slots % SEGMENT).astype("<u2"), np.minimum(counts, 255).astype(np.uint8)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(owner[starts].astype(np.int32)),
            pa.array([inner[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            pa.array([few[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
        ],
        names=["segment", "slots", "counts"],
    )


def repeated_bits(hashes: DataFrame, segments: int) -> DataFrame:
    """``segment, bits``: which slots were counted twice or more; ``hashes`` has one long column."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(slots_of(batch.column(0).to_numpy(zero_copy_only=False), segments).ravel())
                size += len(held[-1])
            if size >= GATHERED:
                yield _parts(*np.unique(np.concatenate(held), return_counts=True))
                held, size = [], 0
        if size:
            yield _parts(*np.unique(np.concatenate(held), return_counts=True))

    def merge(parts: pa.Table) -> pa.Table:
        slots = np.frombuffer(b"".join(parts.column("slots").to_pylist()), "<u2")
        counts = np.frombuffer(b"".join(parts.column("counts").to_pylist()), np.uint8)
        total = np.bincount(slots, weights=counts, minlength=SEGMENT)
        bits = np.packbits(total >= 2).tobytes()
        return pa.table({"segment": parts.column("segment").slice(0, 1), "bits": pa.array([bits], pa.binary())})

    return hashes.mapInArrow(build, _PART).groupBy("segment").applyInArrow(merge, "segment int, bits binary")


def possible_repeat(hashes: DataFrame, rows: int, most: int = MAX_SEGMENTS) -> Callable[[Column], Column]:
    """A test of a hash column: false only for hashes which occur once among the ``rows`` of ``hashes``."""
    segments = segments_for(rows, most)
    table = np.zeros((segments, SEGMENT // 8), np.uint8)
    for row in repeated_bits(hashes, segments).toLocalIterator():
        table[row.segment] = np.frombuffer(row.bits, np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(table.ravel())

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        slots = slots_of(values.to_numpy(), segments).astype(np.int64)
        set_bits = shared.value[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1
        return pd.Series(set_bits.all(axis=0))

    return test
