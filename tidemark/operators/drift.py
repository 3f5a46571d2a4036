"""Drift tests of a stream: static against dynamic window, of fixed or adaptive length.

Input is one row per position with ``hit`` (1 if the prediction was right) and the sparse
n-gram counts of the row, ``term_ids`` and ``term_counts``, over a vocabulary of bounded size.  After row ``index`` (1-based) with ``index > cold_start`` the two windows are compared:
accuracy gap, and chi-square p-value of their n-gram totals.

With windows of fixed length the work is cut into blocks of ``block_rows`` positions, each with a
copy of the rows it may look back at; with adaptive ones a shard is walked in order.  The window
totals of a block, or of a batch of the walk, come from prefix sums in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.special import chi2_tail, tail_against
from tidemark.plans.scan import block_of, with_halo, with_position
from tidemark.schemas import DRIFT_LOG


@dataclass(frozen=True)
class DriftSettings:
    # ---- fixed values: thresholds of the test ----
    cold_start: int = 500
    max_rows: int = 2000
    gap: float = 0.05
    p_drift: float = 0.05
    p_grow: float = 0.5
    p_shrink: float = 0.1
    min_count: int = 6
    # ----------------------------------------------
    adaptive: bool = True
    block_rows: int = 20_000

    @property
    def reach(self) -> int:
        """Rows which a test may look back at, besides its own."""
        return self.max_rows + 1 if self.adaptive else self.cold_start


def sparse_terms(counts: DataFrame, vocab: DataFrame, keys: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """One row per key with ``term_ids`` (places in the vocabulary) and ``term_counts``.

    The lists of a text have at most as many entries as the vocabulary.
    """
    indexed = number_terms(vocab, group)
    return (
        counts.join(indexed, [*group, "term"])
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("idx", F.col("cnt").cast("int").alias("cnt"))).alias("_t"))
        .select(*keys, F.col("_t.idx").alias("term_ids"), F.col("_t.cnt").alias("term_counts"))
    )


def number_terms(vocab: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Number the terms from 0 in alphabetical order within their group (a bounded table)."""
    listed = vocab.groupBy(*group).agg(F.sort_array(F.collect_list("term")).alias("_terms"))
    return listed.select(*group, F.posexplode("_terms").alias("idx", "term"))


#: Rows tested at once: to begin with, and at most.
_SLICE, _LONGEST_SLICE = 8, 1024

#: Rows of a shard which a walk takes in at once.
PIECE = 4096


class _Block:
    """Prefix sums of one block, halo included; positions are those of the stream."""

    def __init__(self, rows: pd.DataFrame, width: int):
        rows = rows.sort_values("pos", kind="stable")
        self.first = int(rows["pos"].iloc[0])
        self.own = rows.loc[~rows["halo"], "pos"].to_numpy(np.int64)
        # counts of a block and its halo, so 32 bits hold every prefix
        counts = np.zeros((len(rows) + 1, width), np.int32)
        ids, values = rows["term_ids"].to_numpy(), rows["term_counts"].to_numpy()
        sizes = [0 if v is None else len(v) for v in ids]
        if sum(sizes):
            at = np.repeat(np.arange(1, len(rows) + 1), sizes)
            flat = [v for v in ids if v is not None], [v for v in values if v is not None]
            counts[at, np.concatenate(flat[0])] = np.concatenate(flat[1])
        np.cumsum(counts, axis=0, out=counts)
        self.terms = counts
        self.hits = np.concatenate([[0], rows["hit"].to_numpy(np.int64).cumsum()])

    def totals(self, low, high) -> np.ndarray:
        return (self.terms[high - self.first] - self.terms[low - self.first]).astype(np.int64)

    def accuracy(self, low, high):
        return (self.hits[high - self.first] - self.hits[low - self.first]) / (high - low)


def homogeneity(a: np.ndarray, b: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chi-square statistic, p-value and number of usable terms of row pairs ``a``, ``b``."""
    statistic, n_terms = compared(a, b, min_count)
    return statistic, p_values(statistic, n_terms), n_terms


def p_values(statistic: np.ndarray, n_terms: np.ndarray) -> np.ndarray:
    return chi2_tail(statistic, np.maximum(n_terms - 1, 0))


def compared(a: np.ndarray, b: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Chi-square statistic and number of usable terms of row pairs ``a``, ``b``."""
    usable = np.minimum(a, b) >= min_count
    a = np.where(usable, a, 0).astype(float)
    b = np.where(usable, b, 0).astype(float)
    n_terms = usable.sum(axis=1)
    ta, tb = a.sum(axis=1, keepdims=True), b.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        ea = (a + b) * ta / (ta + tb)
        eb = (a + b) * tb / (ta + tb)
        gap = np.abs(a - ea)
        gap = np.where(n_terms[:, None] == 2, gap - np.minimum(0.5, gap), gap)
        part = gap * gap / ea + gap * gap / eb
    return np.where(usable, part, 0.0).sum(axis=1), n_terms


def begun(block, settings: DriftSettings) -> dict:
    """The state before the first test; the first static window lies at the head of the stream."""
    cold = settings.cold_start
    return {
        "static_from": 0,
        "static_to": cold,
        "length": cold,
        "static_accuracy": float(block.accuracy(0, cold)),
        "static_terms": block.totals(0, cold),
    }


def tested(block, state: dict, index: np.ndarray, move: int, settings: DriftSettings, stop: bool = False) -> dict:
    """The tests of the rows ``index`` as columns of the log, and the ``state`` moved on.

    The length of the next window hangs on the test before it, but it mostly goes on as it
    went: so the rows are tested at once as if the last ``move`` went on, and kept up to the
    first where the move was another one, or which moves the static window (``stop``: any trigger).
    On which side of its bounds a p-value lies is told here; ``p_values`` of all kept rows are reckoned
    at once, by the caller.
    """
    cold, most = settings.cold_start, settings.max_rows + 1
    path = np.clip(state["length"] + move * np.arange(len(index) + 1), cold, most)
    length, assumed = path[:-1], path[1:]
    accuracy = block.accuracy(index - length, index)
    dynamic = block.totals(index - length, index)
    static = np.broadcast_to(state["static_terms"], dynamic.shape)
    statistic, n_terms = compared(static, dynamic, settings.min_count)
    dof = np.maximum(n_terms - 1, 0)
    gap = np.abs(state["static_accuracy"] - accuracy)
    following = length.copy()
    if settings.adaptive:
        following += (tail_against(statistic, dof, settings.p_grow) >= 0) & (length < most)
        following -= (tail_against(statistic, dof, settings.p_shrink) <= 0) & (length > cold)
    triggered = ((gap >= settings.gap) & (tail_against(statistic, dof, settings.p_drift) <= 0)) | (index == cold + 1)
    # A trigger moves the static window, so what follows has to be tested against it.
    stops = np.flatnonzero((following != assumed) | (triggered & (settings.adaptive or stop)))
    last = int(stops[0]) if len(stops) else len(index) - 1
    columns = {
        "index": index,
        "acc_static": np.full(len(index), state["static_accuracy"]),
        "acc_dynamic": accuracy,
        "gap": gap,
        "n_terms": n_terms.astype(np.int32),
        "statistic": statistic,
        "window_rows": length.astype(np.int32),
        "next_rows": following.astype(np.int32),
        "triggered": triggered.astype(np.int32),
    }
    state["length"] = int(following[last])
    if triggered[last] and settings.adaptive:
        high = int(index[last])
        low = high - state["length"]
        state.update(
            static_from=low,
            static_to=high,
            static_accuracy=float(block.accuracy(low, high)),
            static_terms=block.totals(low, high),
        )
    return {name: values[: last + 1] for name, values in columns.items()}


def _walk(block, state: dict | None, settings: DriftSettings, log: list | None) -> dict | None:
    """Carry the state over the block's own rows; ``log`` collects frames of tests if given."""
    indexes = block.own[block.own >= settings.cold_start] + 1
    if not len(indexes):
        return state
    state = dict(begun(block, settings) if state is None else state)
    done, size, move = 0, _SLICE, 0
    while done < len(indexes):
        index = indexes[done : done + size]
        found = tested(block, state, index, move, settings)
        if log is not None:
            log.append(pd.DataFrame(found))
        kept = len(found["index"])
        move = int(found["next_rows"][-1] - found["window_rows"][-1])
        done += kept
        size = min(2 * size, _LONGEST_SLICE) if kept == len(index) else _SLICE
    return state


class Window:
    """Prefix sums over the last rows of a shard, as a ``_Block`` has them, carried along a stream.

    Rows come in batches; of those before a batch as many stay as a test may look back at.
    """

    def __init__(self, width: int, settings: DriftSettings):
        self.width, self.reach = width, max(settings.max_rows + 1, settings.cold_start)
        self.first = self.end = 0
        self.sizes, self.ids, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.terms, self.hits = np.zeros((1, width), np.int64), np.zeros(1, np.int64)
        self.own = np.zeros(0, np.int64)

    def trim(self) -> int:
        """Leave the rows which later tests may look back at; their number."""
        kept = min(self.reach, self.end - self.first)
        drop = self.end - self.first - kept
        gone = int(self.sizes[:drop].sum())
        self.sizes, self.ids, self.counts = self.sizes[drop:], self.ids[gone:], self.counts[gone:]
        self.hits, self.first = self.hits[drop:] - self.hits[drop], self.first + drop
        self.terms = self.terms[:0]
        return kept

    def extend(self, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray, hits: np.ndarray | None = None) -> None:
        """More rows: how many terms each has, the terms and their counts, and whether it was a hit, if known yet."""
        kept, more = self.trim(), len(sizes)
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        self.terms = np.zeros((kept + more + 1, self.width), np.int64)
        self.terms[np.repeat(np.arange(1, kept + more + 1), self.sizes), self.ids] = self.counts
        np.cumsum(self.terms, axis=0, out=self.terms)
        self.hits = np.concatenate([self.hits, np.zeros(more, np.int64)])
        self.own = np.arange(self.end, self.end + more)
        self.end += more
        if hits is not None:
            self.mark(self.end - more, hits)

    def mark(self, pos: int, hits: np.ndarray) -> None:
        """Whether the rows from ``pos`` on were hits."""
        at = pos - self.first
        self.hits[at + 1 : at + 1 + len(hits)] = self.hits[at] + np.cumsum(hits)

    def totals(self, low, high) -> np.ndarray:
        return self.terms[high - self.first] - self.terms[low - self.first]

    def accuracy(self, low, high):
        return (self.hits[high - self.first] - self.hits[low - self.first]) / (high - low)


def term_lists(ids: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of terms and counts as ``Window.extend`` takes them."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    flat = ids.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)
    return sizes.astype(np.int64), *flat


def shard_pieces(batch: pa.RecordBatch, most: int = PIECE) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A batch sorted by shard in pieces of one shard and at most ``most`` rows."""
    shards = batch.column("shard").to_numpy(zero_copy_only=False)
    bounds = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
    for low, high in zip(bounds, bounds[1:]):
        for at in range(low, high, most):
            yield int(shards[at]), batch.slice(at, min(most, high - at))


def _log_frame(parts: list[pd.DataFrame], shard) -> pd.DataFrame:
    if parts:
        out = pd.concat(parts, ignore_index=True)
        out["p_value"] = p_values(out["statistic"].to_numpy(), out["n_terms"].to_numpy())
    else:
        out = pd.DataFrame({c: pd.Series(dtype=object) for c in _LOG_COLUMNS})
    out.insert(0, "shard", shard)
    return out[["shard", *_LOG_COLUMNS]]


_LOG_COLUMNS = [f.name for f in DRIFT_LOG.fields if f.name != "shard"]


def _blocks(rows: DataFrame, settings: DriftSettings) -> DataFrame:
    """Blocks of the rows, numbered from 1, each with copies of the last rows before it."""
    size = settings.block_rows
    if size <= settings.reach:
        raise ValueError("block_rows must exceed the look-back")
    slim = rows.select(
        "shard", "pos", F.col("hit").cast("int").alias("hit"), "term_ids", "term_counts",
        (F.col("pos") + size).alias("_shifted"),
    )
    return (
        with_halo(slim, settings.reach, pos="_shifted", block_rows=size)
        .where(F.col("block") >= 1)
        .drop("_shifted")
    )


def _paired(blocks: DataFrame, per_block: DataFrame):
    """Each block with its one-row companion; both sides hash on (shard, block).

    A block is little data and much arithmetic, so the number of tasks is stated: left to
    itself the engine would join small partitions by their bytes and run blocks in turn.
    """
    spark = blocks.sparkSession
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        4 * spark.sparkContext.defaultParallelism,
    )
    companion = per_block.withColumnsRenamed({"shard": "_shard", "block": "_block"})
    left = blocks.repartition(tasks, "shard", "block")
    right = companion.repartition(tasks, "_shard", "_block")
    return left.groupBy("shard", "block").cogroup(right.groupBy("_shard", "_block"))


def _widths(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("shard").agg(F.count(F.lit(1)).cast("int").alias("width"))


def drift_fixed(rows: DataFrame, vocab: DataFrame, settings: DriftSettings = DriftSettings(adaptive=False)) -> DataFrame:
    """Compare the first ``cold_start`` rows of a shard with the last ``cold_start`` at each row.

    Every block is on its own: its rows, the rows just before it, and the shard's static
    totals (one list per shard, as long as the vocabulary).
    """
    first = rows.where(F.col("pos") < settings.cold_start)
    static_accuracy = first.groupBy("shard").agg(F.avg("hit").alias("static_accuracy"))
    static_terms = (
        first.select("shard", F.inline(F.arrays_zip("term_ids", "term_counts")))
        .groupBy("shard", "term_ids")
        .agg(F.sum("term_counts").alias("total"))
        .groupBy("shard")
        .agg(F.collect_list(F.struct("term_ids", "total")).alias("_t"))
        .select("shard", F.col("_t.term_ids").alias("static_ids"), F.col("_t.total").alias("static_totals"))
    )
    static = (
        static_accuracy.join(static_terms, "shard", "left").join(_widths(vocab), "shard", "left")
    )
    blocks = _blocks(rows, settings)

    def test(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            # A block which holds nothing but copies of the last rows.
            return _log_frame([], key[0])
        one = right.iloc[0]
        width = int(one["width"]) if pd.notna(one["width"]) else 0
        totals = np.zeros(width, np.int64)
        if one["static_ids"] is not None:
            totals[one["static_ids"]] = one["static_totals"]
        state = {
            "length": settings.cold_start,
            "static_accuracy": float(one["static_accuracy"]),
            "static_terms": totals,
        }
        log: list[pd.DataFrame] = []
        _walk(_Block(left, width), state, settings, log)
        return _log_frame(log, key[0])

    # The static side is repeated per block, so that a shard is not one group.
    places = rows.select(
        "shard", (block_of("pos", settings.block_rows) + 1).alias("block")
    ).distinct()
    return _paired(blocks, places.join(static, "shard")).applyInPandas(test, DRIFT_LOG)


def drift_adaptive(rows: DataFrame, vocab: DataFrame, settings: DriftSettings = DriftSettings()) -> DataFrame:
    """The same test with a dynamic window which grows and shrinks, and a static window which
    moves to the last rows at each trigger.

    Length and static window depend on every earlier test, so the tests of a shard form a chain.
    A task walks its shards in order, batch by batch, and holds the rows a test may look back at.
    """
    slim = rows.select("shard", "pos", F.col("hit").cast("int").alias("hit"), "term_ids", "term_counts")
    widths = {r["shard"]: r["width"] for r in _widths(vocab).collect()}  # a number a shard

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, window, state = None, None, None
        for batch in batches:
            log: list[pd.DataFrame] = []
            for shard, piece in shard_pieces(batch):
                if window is None or shard != current:
                    current, window, state = shard, Window(widths.get(shard, 0), settings), None
                own: list[pd.DataFrame] = []
                hits = piece.column("hit").to_numpy(zero_copy_only=False)
                window.extend(*term_lists(piece.column("term_ids"), piece.column("term_counts")), hits)
                state = _walk(window, state, settings, own)
                log += [_log_frame(own, shard)] if own else []
            if log:
                yield pa.RecordBatch.from_pandas(pd.concat(log), to_arrow_schema(DRIFT_LOG), preserve_index=False)

    return slim.repartition("shard").sortWithinPartitions("shard", "pos").mapInArrow(walk, DRIFT_LOG)


def model_epochs(log: DataFrame) -> DataFrame:
    """The triggers of a drift log as model versions, with training rows and span of use.

    Version v is trained on the window of its trigger, rows [train_from, train_to), and used
    up to the next trigger; ``used_to`` is null for the last one.  The window has moved its
    length before the model is trained, so it is ``next_rows`` long.
    """
    triggers = log.where(F.col("triggered") == 1).select("shard", "index", "next_rows")
    numbered = with_position(triggers, ["index"], ["shard"], "epochs").select(
        "shard",
        (F.col("pos") + 1).alias("version"),
        (F.col("index") - F.col("next_rows")).alias("train_from"),
        F.col("index").alias("train_to"),
    )
    following = numbered.select(
        "shard", (F.col("version") - 1).alias("version"), F.col("train_to").alias("used_to")
    )
    return numbered.join(following, ["shard", "version"], "left")


__all__ = [
    "DriftSettings",
    "Window",
    "begun",
    "compared",
    "drift_adaptive",
    "drift_fixed",
    "homogeneity",
    "model_epochs",
    "number_terms",
    "p_values",
    "shard_pieces",
    "sparse_terms",
    "term_lists",
    "tested",
]
