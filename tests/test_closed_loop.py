"""The closed loop against a plain loop over the whole stream."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import closed_loop, drift
from tidemark.operators.bayes import Candidate
from tidemark.operators.metrics import shard_metrics
from tests.test_drift import plain_chi2

SETTINGS = drift.DriftSettings(cold_start=20, max_rows=60, min_count=3)
FEATURES = ("a", "b", "c")
CANDIDATES = [Candidate(("a",)), Candidate(("a", "b", "c")), Candidate(("b",), 4.0), Candidate(("c",))]


def make(n, seed):
    """What tells the classes apart, and the words, change every 80 rows."""
    rng, rows = random.Random(seed), []
    for pos in range(n):
        phase, y = pos // 80 % 2, rng.random() < 0.4
        rows.append(
            (
                pos, "fake" if y else "nofake", rng.gauss(3 * y if phase == 0 else -3 * y, 1), float(rng.random() < (0.8 if y else 0.2)),
                7.0, [rng.choice((0, 1, 2)) + (2 if t % 2 == phase else 0) for t in range(4)],
            )
        )
    return rows


def guess(rows, candidate):
    """Gaussian naive Bayes fitted anew on the given rows; features with one value do not count."""
    def score(label, x):
        own = [r for r in rows if r[1] == label]
        out = math.log(len(own))
        for k, name in enumerate(FEATURES):
            if name not in candidate.features or len({r[2 + k] for r in rows}) < 2:
                continue
            values = np.array([r[2 + k] for r in own])
            var = max(values.var(), candidate.var_floor)
            out += -0.5 * math.log(var) - (x[2 + k] - values.mean()) ** 2 / (2 * var)
        return out

    def one(row):
        if len({r[1] for r in rows}) < 2:
            return "nofake"
        return "fake" if score("fake", row) > score("nofake", row) else "nofake"

    return one


def plain(rows, s, to_initial):
    began, current, length, out, hits = 0, 0, s.cold_start, [], []
    first, last = 0, s.cold_start
    for pos, row in enumerate(rows):
        y_pred = guess(rows[began:pos], CANDIDATES[current])(row)
        hits.append(int(y_pred == row[1]))
        index, test, retrained = pos + 1, None, 0
        if index > s.cold_start:
            terms = np.array([r[5] for r in rows])
            x, p, n = plain_chi2(terms[first:last].sum(0), terms[index - length : index].sum(0), s.min_count)
            gap = abs(np.mean(hits[first:last]) - np.mean(hits[index - length : index]))
            used = length
            if s.adaptive:
                length += p >= s.p_grow and length <= s.max_rows
                length -= p <= s.p_shrink and used > s.cold_start
            trigger = (gap >= s.gap and p <= s.p_drift) or index == s.cold_start + 1
            test = (round(gap, 9), round(p, 6), used, length, int(trigger))
            if trigger:
                low = index - length
                if s.adaptive:
                    first, last = low, index
                scores = [
                    sum(guess(rows[low:k], c)(rows[k]) == rows[k][1] for k in range(low, index)) for c in CANDIDATES
                ]
                best = scores.index(max(scores))
                if best != (0 if to_initial else current):
                    current, began, retrained = best, low, 1
        out.append((pos, y_pred, test, retrained, current))
    return out


@pytest.mark.parametrize("adaptive, compare_to", [(True, "current"), (False, "current"), (True, "initial")])
def test_equals_the_plain_loop(spark, adaptive, compare_to):
    settings = drift.DriftSettings(adaptive=adaptive, cold_start=20, max_rows=60, min_count=3)
    shards = {0: make(260, 1), 1: make(170, 2), 2: make(12, 3)}
    table = spark.createDataFrame(
        [(s, *r[:5], list(range(4)), r[5]) for s, rows in shards.items() for r in rows],
        "shard long, pos long, label string, a double, b double, c double, term_ids array<int>, term_counts array<int>",
    ).repartition(5)
    vocab = spark.createDataFrame([(s, f"t{i}") for s in shards for i in range(4)], "shard long, term string")
    walked = closed_loop.walk(table, vocab, FEATURES, CANDIDATES, settings, compare_to).cache()
    got = {}
    for r in walked.orderBy("shard", "pos").collect():
        test = None if r["index"] is None else (round(r["gap"], 9), round(r["p_value"], 6), r["window_rows"], r["next_rows"], r["triggered"])
        got.setdefault(r["shard"], []).append((r["pos"], r["y_pred"], test, r["retrained"], r["candidate"]))
    want = {s: plain(rows, settings, compare_to == "initial") for s, rows in shards.items()}
    assert got == want
    swaps = closed_loop.epochs(walked).collect()
    assert len(swaps) == sum(r[3] for rows in want.values() for r in rows) > 1
    assert all(0 <= s["train_from"] < s["train_to"] for s in swaps)
    log = closed_loop.drift_log(walked)
    assert log.count() == sum(r[2] is not None for rows in want.values() for r in rows)
    scores = {r["shard"]: r for r in shard_metrics(closed_loop.predictions(walked), F.col("triggered")).collect()}
    for shard, rows in want.items():
        assert scores[shard]["drifts"] == sum(r[2] is not None and r[2][4] for r in rows)
    # learning pays: the loop is right far more often than the larger class
    assert scores[0]["accuracy"] > 0.7


def test_bad_settings_are_refused(spark):
    rows = spark.createDataFrame([], "shard long, pos long, label string, a double, term_ids array<int>, term_counts array<int>")
    vocab = spark.createDataFrame([], "shard long, term string")
    with pytest.raises(ValueError):
        closed_loop.walk(rows, vocab, ["a"], [Candidate(("b",))])
    with pytest.raises(ValueError):
        closed_loop.walk(rows, vocab, ["a"], [Candidate(("a",))], compare_to="other")
    assert closed_loop.walk(rows, vocab, ["a"], [Candidate(("a",))]).count() == 0


def walked_in(piece, rows, settings):
    grid = closed_loop.CandidateGrid(CANDIDATES, FEATURES)
    walk, out = closed_loop.ShardWalk(0, 4, 3, grid, settings, False), []
    for low in range(0, len(rows), piece):
        own = rows[low : low + piece]
        terms = np.full(len(own), 4), np.tile(np.arange(4), len(own)), np.concatenate([r[5] for r in own])
        x, y = np.array([r[2:5] for r in own]), np.array([int(r[1] == "fake") for r in own])
        out += walk.take(np.array([r[0] for r in own]), x, y, terms).to_pylist()
    return out


def test_pieces_do_not_matter_and_rows_are_tested_many_at_once(monkeypatch):
    calls, real = [], drift.homogeneity
    monkeypatch.setattr(drift, "homogeneity", lambda a, b, least: (calls.append(len(a)), real(a, b, least))[1])
    rows = make(2000, 4)
    whole = walked_in(2000, rows, SETTINGS)
    assert len(calls) < 1980 / 2 < sum(r["index"] is not None for r in whole) == 1980
    assert sum(r["retrained"] for r in whole) > 1
    assert walked_in(1, rows, SETTINGS) == walked_in(700, rows, SETTINGS) == whole
