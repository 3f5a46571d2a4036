"""Test-then-train with drift handling on a live stream: the closed loop in keyed state.

The state of a shard is what ``operators.closed_loop`` holds of it: the last ``max_rows + 1`` rows
with their hits and terms, the totals of the dynamic and the static window, the adaptive length,
the candidate in force and the learner's sums.  It is as large as a window, whatever has passed.
Rows are taken in the order of their positions; rows ahead of their turn wait in the state, many
to a part, one whose position has passed (late, or sent twice) changes nothing and comes out
marked ``late``.  So what comes out hangs neither on the cut into micro-batches nor on the order
inside them, and equals the batch walk over the same rows.

Terms are given as numbers of a vocabulary, or as ``grams``: then the vocabulary of a shard is
made in its state from its first ``cold_start`` rows, by the rule of ``operators.ngrams``.

The sink writes each micro-batch into a folder of its own, named by its number and replaced if
the batch is run again; so a restart adds no row twice.

Null labels count as ``nofake`` and null features as 0.  Rows without shard or position are left
out.  Rows which wait for a position that never comes stay in the state.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.labels import encode_label
from tidemark.operators.bayes import Candidate
from tidemark.operators.closed_loop import WALK, CandidateGrid, ShardWalk
from tidemark.operators.drift import PIECE, DriftSettings, Window
from tidemark.operators.ngrams import MAX_DF, MIN_DF
from tidemark.plans.staging import new_path
from tidemark.schemas import LABELS
from tidemark.streaming.source import state_partitions

#: The batch walk's columns, and whether the row came too late to be used.
LIVE = T.StructType([*WALK.fields, T.StructField("late", T.IntegerType())])


def fitted_terms(held: Sequence[dict[str, int]], min_df: float, max_df: float) -> dict[str, int]:
    """Numbers of the terms whose share of the rows lies in the given range."""
    found = Counter(t for row in held for t in row)
    kept = sorted(t for t, n in found.items() if len(held) * min_df <= n <= len(held) * max_df)
    return {t: i for i, t in enumerate(kept)}


#: Columns with nulls keep their types.
_NULLABLE = {pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(), pa.float64(): pd.Float64Dtype()}


def listed(terms: Sequence[tuple | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and counts of each row, or nothing, as ``Window.extend`` takes them."""
    own = [t for t in terms if t is not None]
    sizes = np.array([0 if t is None else len(t[0]) for t in terms], np.int64)
    none = np.zeros(0, np.int64)
    return sizes, np.concatenate([none, *(t[0] for t in own)]).astype(np.int64), np.concatenate([none, *(t[1] for t in own)])


#: Rows of a shard: positions, labels, terms as they come, features.
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]

#: Rows of a waiting part: a call to the state costs as much as many rows.
PART = 4096


def _picked(rows: Rows, at: np.ndarray | slice) -> Rows:
    return tuple(column[at] for column in rows)


def _in_order(parts: Sequence[Rows]) -> Rows:
    """Rows by position; of one position those which came first are first."""
    rows = tuple(np.concatenate(columns) for columns in zip(*parts))
    return _picked(rows, np.argsort(rows[0], kind="stable"))


def _runs(pos: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of neighbouring positions."""
    ends = np.flatnonzero(np.diff(pos) != 1)
    return list(zip(pos[np.concatenate([[0], ends + 1])].tolist(), pos[np.concatenate([ends, [len(pos) - 1]])].tolist()))


def _within(pos: np.ndarray, runs: Sequence[tuple[int, int]]) -> np.ndarray:
    """Which positions lie in one of the runs; these share none."""
    if not runs:
        return np.zeros(len(pos), bool)
    first, last = (np.array(c) for c in zip(*sorted(runs)))
    at = np.searchsorted(first, pos, side="right") - 1
    return (at >= 0) & (pos <= last[np.maximum(at, 0)])


class LiveLoop(StatefulProcessor):
    """One shard: rows in order through ``ShardWalk``, those ahead of their turn wait in parts."""

    def __init__(self, features, candidates, settings, to_initial, width, min_df, max_df):
        self.features, self.candidates, self.settings, self.to_initial = features, candidates, settings, to_initial
        self.width, self.min_df, self.max_df = width, min_df, max_df

    def init(self, handle: StatefulProcessorHandle) -> None:
        blob = T.StructType([T.StructField("blob", T.BinaryType())])
        self.kept = handle.getValueState("walk", blob)
        self.waiting = handle.getMapState("waiting", T.StructType([T.StructField("part", T.LongType())]), blob)
        self.grid = CandidateGrid(self.candidates, self.features)

    def _load(self, shard: int) -> tuple[ShardWalk, list, dict | None, dict[int, list[tuple[int, int]]]]:
        """The walk, term counts of rows before the vocabulary, the vocabulary, positions of the parts which wait."""
        walk = ShardWalk(shard, self.width or 0, len(self.features), self.grid, self.settings, self.to_initial)
        if not self.kept.exists():
            return walk, [], None, {}
        fields, held, vocabulary, parts = pickle.loads(self.kept.get()[0])
        walk.__dict__.update(fields)
        return walk, held, vocabulary, parts

    def _save(self, walk: ShardWalk, held: list, vocabulary: dict | None, parts: dict) -> None:
        walk.trim()
        fields = {k: v for k, v in walk.__dict__.items() if k not in ("grid", "settings")}
        self.kept.update((pickle.dumps((fields, held, vocabulary, parts), protocol=5),))

    def _fit(self, walk: ShardWalk, held: list) -> dict[str, int]:
        """The vocabulary, once the cold start is over; the rows before it get their numbers."""
        vocabulary = fitted_terms(held, self.min_df, self.max_df)
        hits = np.diff(walk.window.hits)
        walk.window = Window(len(vocabulary), self.settings)
        walk.window.extend(*listed([self._numbered(counts, vocabulary) for counts in held]), hits)
        return vocabulary

    @staticmethod
    def _numbered(counts: dict[str, int], vocabulary: dict[str, int]):
        own = [(vocabulary[t], n) for t, n in counts.items() if t in vocabulary]
        return tuple(np.array(c, np.int64) for c in zip(*own)) if own else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        walk, held, vocabulary, parts = self._load(int(key[0]))
        names = [f"x{k}" for k in range(len(self.features))]
        given = []
        for frame in rows:
            if frame.empty:
                continue
            terms = np.empty(len(frame), object)
            terms[:] = list(frame["grams"] if self.width is None else zip(frame["ids"], frame["counts"]))
            given.append((frame["place"].to_numpy(np.int64), frame["y"].to_numpy(np.int64), terms, frame[names].to_numpy(float)))
        if not given:
            return
        pool = _in_order(given)
        again = np.concatenate([[False], pool[0][1:] == pool[0][:-1]])
        again |= (pool[0] < walk.seen) | _within(pool[0], [p for runs in parts.values() for p in runs])
        late = [(walk.shard, int(pos), LABELS[y]) for pos, y in zip(pool[0][again], pool[1][again])]
        pool, made = _picked(pool, ~again), []

        def take(part: Rows) -> None:
            """Rows whose turn it is."""
            pos, y, terms, x = part
            if self.width is not None:
                own = [None if ids is None or not len(ids) else (ids, counts) for ids, counts in terms]
            else:
                counted = [dict(Counter(t if t is not None else ())) for t in terms]
                if vocabulary is None:
                    own = [None] * len(pos)
                    held.extend(counted)
                else:
                    own = [self._numbered(c, vocabulary) for c in counted]
            made.append(walk.take(pos, x.reshape(len(pos), len(self.features)), y, listed(own)))

        while True:
            ready = int((pool[0] == walk.seen + np.arange(len(pool[0]))).cumprod().sum())
            part = _picked(pool, slice(0, ready))
            pool = _picked(pool, slice(ready, None))
            while len(part[0]):
                # the cold start is taken apart where the vocabulary is made of it
                cold = max(0, self.settings.cold_start - walk.seen) if self.width is None and vocabulary is None else 0
                size = min(cold, PIECE) or PIECE
                take(_picked(part, slice(0, size)))
                part = _picked(part, slice(size, None))
                if self.width is None and vocabulary is None and walk.seen == self.settings.cold_start:
                    vocabulary = self._fit(walk, held)
                    held.clear()
            due = [n for n, runs in parts.items() if runs[0][0] == walk.seen]
            if not due:
                break
            waited = [pickle.loads(self.waiting.getValue((n,))[0]) for n in due]
            for n in due:
                self.waiting.removeKey((n,))
                parts.pop(n)
            pool = _in_order([pool, *waited])
        number = max(parts, default=-1) + 1
        for at in range(0, len(pool[0]), PART):
            own = _picked(pool, slice(at, at + PART))
            self.waiting.updateValue((number,), (pickle.dumps(own, protocol=5),))
            parts[number] = _runs(own[0])
            number += 1
        self._save(walk, held, vocabulary, parts)
        for batch in made:
            own = batch.to_pandas(types_mapper=_NULLABLE.get)
            yield own.assign(late=pd.array([0] * len(own), dtype="Int32"))
        if late:
            empty = pa.Table.from_pylist([dict(zip(WALK.names, r)) for r in late], schema=to_arrow_schema(WALK))
            own = empty.to_pandas(types_mapper=_NULLABLE.get)
            yield own.assign(late=pd.array([1] * len(late), dtype="Int32"))

    def close(self) -> None:
        pass


def live_loop(
    stream: DataFrame,
    features: Sequence[str],
    candidates: Sequence[Candidate],
    settings: DriftSettings = DriftSettings(),
    compare_to: str = "current",
    width: int | None = None,
    min_df: float = MIN_DF,
    max_df: float = MAX_DF,
) -> DataFrame:
    """``LIVE`` rows of a stream of ``shard, pos, label``, features and terms.

    With ``width`` (terms of the vocabulary) the terms are ``term_ids, term_counts``, else ``grams``.
    """
    if compare_to not in ("current", "initial"):
        raise ValueError(f"compare_to is current or initial, not {compare_to!r}")
    terms = [F.col("grams").alias("grams")] if width is None else [F.col("term_ids").alias("ids"), F.col("term_counts").alias("counts")]
    # names as the engine hands them on: none may begin with an underscore
    slim = stream.where("shard is not null and pos is not null").select(
        F.col("shard").cast("bigint").alias("shard"), F.col("pos").cast("bigint").alias("place"),
        F.coalesce(encode_label("label"), F.lit(0)).alias("y"), *terms,
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{k}") for k, f in enumerate(features)],
    )
    loop = LiveLoop(list(features), list(candidates), settings, compare_to == "initial", width, min_df, max_df)
    return slim.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=loop, outputStructType=LIVE, outputMode="Append", timeMode="None"
    )


def once(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink for micro-batches: a folder each, replaced when the batch is run again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def run_to_end(walked: DataFrame, folder: str, checkpoint: str) -> None:
    """Take in what the source holds now; a later call with the same folders goes on from there."""
    writer = (
        walked.writeStream.foreachBatch(once(folder))
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    with state_partitions(walked.sparkSession):
        query = writer.start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def read_live(spark: SparkSession, folder: str) -> DataFrame:
    """All rows written so far; ``closed_loop.drift_log`` and the like take those which are not late."""
    return spark.read.schema(LIVE).parquet(folder)


def late_rows(live: DataFrame) -> DataFrame:
    """Rows which came after their turn, with how often each did."""
    late = live.where("late = 1")
    return late.groupBy("shard", "pos").agg(F.count(F.lit(1)).alias("times"))


def replayed(stream: DataFrame, *args, **kw) -> DataFrame:
    """Run a stream to its end and read back what its walk wrote."""
    spark = stream.sparkSession
    folder = new_path(spark, "live-loop")
    run_to_end(live_loop(stream, *args, **kw), folder, new_path(spark, "live-state"))
    return read_live(spark, folder)


__all__ = ["LIVE", "late_rows", "live_loop", "once", "read_live", "replayed", "run_to_end"]
