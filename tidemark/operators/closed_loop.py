"""Test-then-train with drift handling as one pass per shard: predict, test, retrain, learn.

What a row's prediction is depends on every trigger before it, so a shard is a chain.  The rows
are dealt by shard and sorted by position by the engine (which spills); a task then reads them
batch by batch and holds the last ``max_rows + 1`` rows, prefix sums over them and over a piece of
a batch, and the learner's sums, and nothing that grows with the shard.  Rows up to the next new
model are predicted and tested at once in numpy.  All shards walk at the same time, and nothing
passes through the driver.  The learner is Gaussian naive Bayes on features which vary (the
running variance selector); its state is a count, mean and sum of squares per class, so a
retrain is the window's own sums.

At a trigger every candidate is replayed test-then-train over the dynamic window, whose length
has moved before.  The best (the earliest of equals) replaces the model at once, trained on that
window, unless it is the candidate in force (``compare_to="initial"``: the first one).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.functions.labels import encode_label
from tidemark.operators.bayes import Candidate
from tidemark.operators.drift import (
    _LONGEST_SLICE,
    _SLICE,
    DriftSettings,
    Window,
    begun,
    p_values,
    shard_pieces,
    term_lists,
    tested,
)
from tidemark.schemas import DRIFT_LOG, LABELS

#: One row per stream row; the columns of the drift log are null where no test was made.
WALK = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("y", T.StringType()),
        T.StructField("y_pred", T.StringType()),
        *[f for f in DRIFT_LOG.fields if f.name != "shard"],
        T.StructField("retrained", T.IntegerType()),
        T.StructField("candidate", T.IntegerType()),
        T.StructField("train_from", T.LongType()),
    ]
)


#: Rows which are predicted at once: to begin with, and at most; numbers that a step of them may take.
_AHEAD, _FARTHEST, _NUMBERS = 32, 1024, 1 << 19

#: Up to so many features are learned one by one as plain numbers, more of them side by side.
_FEW = 8


class _Sums:
    """Count, mean and sum of squared gaps per class, and the range of each feature."""

    def __init__(self, width: int):
        self.n = np.zeros(2)
        self.mean, self.gaps = np.zeros((2, width)), np.zeros((2, width))
        self.low, self.high = np.full(width, np.inf), np.full(width, -np.inf)


class _Learned:
    """The sums before each of some rows, and after the last: rows are learned one by one, then
    whatever looks at the sums does so for all rows at once."""

    def __init__(self, sums: _Sums, x: np.ndarray, y: np.ndarray):
        self.x = x
        of = np.zeros((len(y) + 1, 2), np.int64)
        of[np.arange(1, len(y) + 1), y] = 1
        of = of.cumsum(axis=0)
        self.n = sums.n + of
        self.low = np.minimum.accumulate(np.concatenate([sums.low[None], x]), axis=0)
        self.high = np.maximum.accumulate(np.concatenate([sums.high[None], x]), axis=0)
        self.mean, self.gaps = (np.empty((len(y) + 1, 2, x.shape[1])) for _ in range(2))
        for label in (0, 1):
            own, n = x[y == label], sums.n[label]
            mean, gaps = (np.empty((len(own) + 1, x.shape[1])) for _ in range(2))
            mean[0], gaps[0] = sums.mean[label], sums.gaps[label]
            if x.shape[1] <= _FEW:
                for f in range(x.shape[1]):
                    mean[1:, f], gaps[1:, f] = self._column(own[:, f].tolist(), float(n), float(mean[0, f]), float(gaps[0, f]))
            else:
                for k, row in enumerate(own):
                    n += 1
                    gap = row - mean[k]
                    np.add(mean[k], gap / n, out=mean[k + 1])
                    np.add(gaps[k], gap * (row - mean[k + 1]), out=gaps[k + 1])
            self.mean[:, label], self.gaps[:, label] = mean[of[:, label]], gaps[of[:, label]]

    @staticmethod
    def _column(values: list[float], n: float, mean: float, gaps: float) -> tuple[list[float], list[float]]:
        means, sums = [], []
        for v in values:
            n += 1.0
            gap = v - mean
            mean += gap / n
            gaps += gap * (v - mean)
            means.append(mean)
            sums.append(gaps)
        return means, sums

    def after(self, rows: int) -> _Sums:
        """The sums once so many rows are learned."""
        sums = _Sums(self.x.shape[1])
        for name in ("n", "mean", "gaps", "low", "high"):
            setattr(sums, name, getattr(self, name)[rows].copy())
        return sums

    def terms(self, floors: np.ndarray) -> np.ndarray:
        """What each feature adds to the score of a class, by row and floor; nothing while it has not varied."""
        with np.errstate(divide="ignore", invalid="ignore"):
            var = np.maximum((self.gaps[:-1] / self.n[:-1, :, None])[:, None], floors[:, None, None])
            gap = (self.x[:, None] - self.mean[:-1])[:, None]
            varied = (self.low[:-1] < self.high[:-1])[:, None, None]
            return np.where(varied, -0.5 * np.log(var) - gap * gap / (2 * var), 0.0)

    def predict(self, mask: np.ndarray, floor: float) -> np.ndarray:
        with np.errstate(divide="ignore"):
            score = np.log(self.n[:-1]) + (self.terms(np.array([floor]))[:, 0] * mask).sum(axis=2)
        return ((score[:, 1] > score[:, 0]) & self.n[:-1].all(axis=1)).astype(np.int64)


class CandidateGrid:
    """The candidates as masks over the features, grouped by variance floor."""

    def __init__(self, candidates: Sequence[Candidate], features: Sequence[str]):
        self.masks = np.array([[float(f in c.features) for f in features] for c in candidates])
        self.floors = [c.var_floor for c in candidates]
        self.distinct, self.floor_of = np.unique(self.floors, return_inverse=True)

    def replay(self, x: np.ndarray, y: np.ndarray) -> tuple[int, _Sums]:
        """The candidate with most hits on the rows, and the sums after learning them all."""
        sums, hits = _Sums(x.shape[1]), np.zeros(len(self.floors), np.int64)
        step = max(1, min(_FARTHEST, _NUMBERS // (2 * x.shape[1] * len(self.distinct))))
        for low in range(0, len(y), step):
            own = y[low : low + step]
            learned = _Learned(sums, x[low : low + step], own)
            terms = learned.terms(self.distinct)
            with np.errstate(divide="ignore"):
                logs = np.log(learned.n)
            both = np.flatnonzero(learned.n[:-1].all(axis=1))
            hits += int((own == 0).sum() - (own[both] == 0).sum())  # nothing but the first class before them
            some = max(1, _NUMBERS // (2 * self.masks.size))
            for at in range(0, len(both), some):
                k = both[at : at + some]
                score = np.einsum("cw,kclw->kcl", self.masks, terms[k][:, self.floor_of])
                ahead = logs[k, 1, None] + score[:, :, 1] > logs[k, 0, None] + score[:, :, 0]
                hits += (ahead == own[k, None]).sum(axis=0)
            sums = learned.after(len(own))
        return int(hits.argmax()), sums


class ShardWalk:
    """The state of one shard."""

    def __init__(self, shard: int, width: int, n_features: int, grid: CandidateGrid, settings: DriftSettings, to_initial: bool):
        self.shard, self.grid, self.settings, self.to_initial = shard, grid, settings, to_initial
        self.sums, self.current, self.seen = _Sums(n_features), 0, 0
        self.window, self.state = Window(width, settings), None
        #: Features and labels of the rows in the window.
        self.x, self.y = np.zeros((0, n_features)), np.zeros(0, np.int64)

    def trim(self) -> None:
        """Leave what later rows need."""
        kept = self.window.trim()
        self.x, self.y = self.x[len(self.y) - kept :], self.y[len(self.y) - kept :]

    def take(self, pos: np.ndarray, x: np.ndarray, y: np.ndarray, terms: Sequence[np.ndarray]) -> pa.RecordBatch:
        """Rows of the shard in order, ``terms`` as ``Window.extend`` takes them; their ``WALK`` rows.

        What a row's prediction is hangs on the triggers before it, but few rows bring a new model: rows
        are predicted and tested at once as if none did, and kept up to the first which does.
        """
        self.trim()
        self.x, self.y = np.concatenate([self.x, x]), np.concatenate([self.y, y])
        self.window.extend(*terms)
        low, rows = self.seen, len(y)
        guess, candidate, from_ = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.full(rows, -1)
        farthest = max(1, min(_FARTHEST, _NUMBERS // (2 * max(1, x.shape[1]))))
        at, size, log = 0, min(_AHEAD, farthest), []
        while at < rows:
            upto = min(rows, at + size)
            learned = _Learned(self.sums, x[at:upto], y[at:upto])
            guess[at:upto] = learned.predict(self.grid.masks[self.current], self.grid.floors[self.current])
            self.window.mark(low + at, guess[at:upto] == y[at:upto])
            candidate[at:upto] = self.current
            renewed = self._test(low + at, low + upto, log)
            if renewed is None:
                self.sums, at, size = learned.after(upto - at), upto, min(2 * size, farthest)
                continue
            index, self.current, self.sums = renewed
            at, size = index - low, min(_AHEAD, farthest)
            candidate[at - 1], from_[at - 1] = self.current, index - self.state["length"]
        self.seen += rows
        return self._rows(pos, y, guess, candidate, from_, log)

    def _test(self, low: int, high: int, log: list[dict]) -> tuple[int, int, _Sums] | None:
        """Test the rows of these positions up to one which brings a new model: its index, candidate and sums."""
        s = self.settings
        index, move, size = max(low, s.cold_start) + 1, 0, _SLICE
        while index <= high:
            if self.state is None:
                self.state = begun(self.window, s)
            wanted = np.arange(index, min(index + size, high + 1))
            found = tested(self.window, self.state, wanted, move, s, stop=True)
            log.append(found)
            kept, last = len(found["index"]), int(found["index"][-1])
            move = int(found["next_rows"][-1] - found["window_rows"][-1])
            size = min(2 * size, _LONGEST_SLICE) if kept == len(wanted) else _SLICE
            index = last + 1
            if found["triggered"][-1]:
                own = slice(last - self.state["length"] - self.window.first, last - self.window.first)
                best, sums = self.grid.replay(self.x[own], self.y[own])
                if best != (0 if self.to_initial else self.current):
                    return last, best, sums
        return None

    def _rows(self, pos, y, guess, candidate, from_, log: list[dict]) -> pa.RecordBatch:
        labels = np.array(LABELS, dtype=object)
        rows, tests = len(y), sum(len(t["index"]) for t in log)
        tested_ = {n: np.concatenate([np.zeros(0), *(t[n] for t in log)]) for n in ("statistic", "n_terms")}
        p_value = p_values(tested_["statistic"], tested_["n_terms"].astype(np.int64))
        columns = {
            "shard": np.full(rows, self.shard), "pos": pos, "y": labels[y], "y_pred": labels[guess],
            "retrained": (from_ >= 0).astype(np.int32), "candidate": candidate,
        }
        untested = np.arange(rows) < rows - tests  # the cold start
        arrays = []
        for f in WALK.fields:
            kind = to_arrow_type(f.dataType)
            if f.name in columns:
                arrays.append(pa.array(columns[f.name], kind))
            elif f.name == "train_from":
                arrays.append(pa.array(from_, kind, mask=from_ < 0))
            else:
                own = [p_value] if f.name == "p_value" else [t[f.name] for t in log]
                values = np.concatenate([np.zeros(rows - tests), *own])
                arrays.append(pa.array(values, pa.float64(), mask=untested, from_pandas=True).cast(kind))
        return pa.RecordBatch.from_arrays(arrays, names=WALK.names)


def walk(
    rows: DataFrame,
    vocab: DataFrame,
    features: Sequence[str],
    candidates: Sequence[Candidate],
    settings: DriftSettings = DriftSettings(),
    compare_to: str = "current",
) -> DataFrame:
    """One row per row of the stream (``WALK``): prediction, drift test and retraining.

    ``rows``: ``shard``, ``pos``, ``label``, the features (null counts as 0) and the n-gram lists
    ``term_ids``, ``term_counts`` over ``vocab``, whose width is that of its largest shard.
    Candidate 0 is in force at the start.
    """
    if compare_to not in ("current", "initial"):
        raise ValueError(f"compare_to is current or initial, not {compare_to!r}")
    unknown = {f for c in candidates for f in c.features} - set(features)
    if unknown or not candidates:
        raise ValueError(f"candidates must use given features, not {sorted(unknown)}")
    widest = vocab.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    width, names = int(widest or 0), [f"_x{k}" for k in range(len(features))]
    grid = CandidateGrid(candidates, features)
    slim = rows.select(
        "shard", "pos", F.coalesce(encode_label("label"), F.lit(0)).alias("_y"), "term_ids", "term_counts",
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(n) for f, n in zip(features, names, strict=True)],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for shard, piece in shard_pieces(batch):
                if state is None or state.shard != shard:
                    state = ShardWalk(shard, width, len(features), grid, settings, compare_to == "initial")
                x = np.stack([piece.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)
                pos, y = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "_y"))
                yield state.take(pos, x, y.astype(np.int64), term_lists(piece.column("term_ids"), piece.column("term_counts")))

    # one exchange by shard; within a task the rows of a shard follow each other in order
    placed = slim.repartition("shard").sortWithinPartitions("shard", "pos")
    return placed.mapInArrow(run, WALK)


def predictions(walked: DataFrame) -> DataFrame:
    return walked.select("shard", "pos", "y", "y_pred", F.coalesce("triggered", F.lit(0)).alias("triggered"))


def drift_log(walked: DataFrame) -> DataFrame:
    """The tests, as ``DRIFT_LOG``."""
    return walked.where(F.col("index").isNotNull()).select(*DRIFT_LOG.names)


def epochs(walked: DataFrame) -> DataFrame:
    """The models which came into force: trained on [train_from, train_to), used from there on."""
    return walked.where(F.col("retrained") == 1).select(
        "shard", "train_from", F.col("index").alias("train_to"), "candidate"
    )


__all__ = ["WALK", "drift_log", "epochs", "predictions", "walk"]
