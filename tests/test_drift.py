"""Chi-square, drift tests and their blocks, against plain Python."""

import math
import random

import numpy as np
import pytest

from tidemark.functions.special import chi2_tail
from tidemark.operators import drift
from tidemark.operators.ngrams import chi_square

SMALL = dict(cold_start=20, max_rows=60, block_rows=70, min_count=3)


@pytest.mark.parametrize("dof,x", [(1, 3.841), (2, 5.991), (10, 18.307), (30, 43.773), (100, 124.342)])
def test_tail_against_printed_tables(dof, x):
    assert chi2_tail([x], [dof])[0] == pytest.approx(0.05, abs=2e-5)


@pytest.mark.parametrize("dof", [2, 4, 20, 200])
@pytest.mark.parametrize("x", [0.01, 1.0, 15.0, 180.0, 260.0, 2000.0])
def test_tail_against_closed_form(dof, x):
    terms = [-x / 2 + i * math.log(x / 2) - math.lgamma(i + 1) for i in range(dof // 2)]
    assert chi2_tail([x], [dof])[0] == pytest.approx(sum(map(math.exp, terms)), rel=1e-9, abs=1e-300)


def test_tail_edges():
    assert list(chi2_tail([0.0, 5.0, 0.0], [3, 0, 0])) == [1.0, 1.0, 1.0]


def plain_chi2(a, b, least):
    pairs = [(x, y) for x, y in zip(a, b) if min(x, y) >= least]
    if len(pairs) < 2:
        return 0.0, 1.0, len(pairs)
    ta, tb = sum(p[0] for p in pairs), sum(p[1] for p in pairs)
    total = 0.0
    for x, y in pairs:
        for o, t in ((x, ta), (y, tb)):
            e = (x + y) * t / (ta + tb)
            gap = abs(o - e)
            if len(pairs) == 2:
                gap -= min(0.5, gap)
            total += gap * gap / e
    return total, float(chi2_tail([total], [len(pairs) - 1])[0]), len(pairs)


@pytest.mark.parametrize(
    "a,b", [([5, 6, 50], [60, 6, 40]), ([5, 5], [9, 9]), ([8, 5], [9, 9]), ([10, 20, 30], [12, 18, 33])]
)
def test_both_forms_of_the_test(spark, a, b):
    x, p, n = plain_chi2(a, b, 6)
    cells = spark.createDataFrame([(0, f"t{i}", u, v) for i, (u, v) in enumerate(zip(a, b))], "k int, term string, a long, b long")
    row = chi_square(cells, "a", "b", ["k"]).first()
    assert (row["statistic"], row["p_value"], row["n_terms"]) == (pytest.approx(x), pytest.approx(p), n)
    s, q, m = drift.homogeneity(np.array([a]), np.array([b]), 6)
    assert (s[0], q[0], m[0]) == (pytest.approx(x), pytest.approx(p), n)


def make_stream(n, width, seed, shift):
    """Term rates and accuracy change every ``shift`` rows."""
    rng = random.Random(seed)
    counts, hits = [], []
    for i in range(n):
        phase = i // shift % 2
        counts.append([rng.choice([0, 0, 1, 2]) + (2 if (t % 2 == phase) and rng.random() < 0.6 else 0) for t in range(width)])
        hits.append(int(rng.random() < (0.9 if phase == 0 else 0.6)))
    return np.array(counts), np.array(hits)


def plain_drift(counts, hits, s):
    """The test as a plain loop over the whole stream."""
    first, last, length, log = 0, s.cold_start, s.cold_start, []
    for pos in range(len(hits)):
        index = pos + 1
        if index <= s.cold_start:
            continue
        x, p, n = plain_chi2(counts[first:last].sum(0), counts[index - length:index].sum(0), s.min_count)
        acc_static, acc = hits[first:last].mean(), hits[index - length:index].mean()
        used = length
        if s.adaptive:
            if p >= s.p_grow and length <= s.max_rows:
                length += 1
            elif p <= s.p_shrink and length > s.cold_start:
                length -= 1
        hit = (abs(acc_static - acc) >= s.gap and p <= s.p_drift) or index == s.cold_start + 1
        if hit and s.adaptive:
            first, last = index - length, index
        log.append((index, round(acc, 9), round(x, 6), round(p, 6), used, int(hit)))
    return log


def frames(spark, streams):
    rows, vocab = [], []
    for shard, (counts, hits) in enumerate(streams):
        for pos, (c, h) in enumerate(zip(counts, hits)):
            ids = [i for i, v in enumerate(c) if v]
            rows.append((shard, pos, int(h), ids or None, [int(c[i]) for i in ids] or None))
        vocab += [(shard, f"t{i:03d}") for i in range(counts.shape[1])]
    return (
        spark.createDataFrame(rows, "shard long, pos long, hit int, term_ids array<int>, term_counts array<int>"),
        spark.createDataFrame(vocab, "shard long, term string"),
    )


def logged(df):
    out = {}
    for r in df.orderBy("shard", "index").collect():
        out.setdefault(r["shard"], []).append(
            (r["index"], round(r["acc_dynamic"], 9), round(r["statistic"], 6), round(r["p_value"], 6), r["window_rows"], r["triggered"])
        )
    return out


@pytest.mark.parametrize("adaptive", [True, False])
def test_blocks_equal_the_plain_loop(spark, adaptive):
    settings = drift.DriftSettings(adaptive=adaptive, **SMALL)
    streams = [make_stream(400, 5, 1, 90), make_stream(230, 5, 2, 1000), make_stream(15, 5, 3, 50)]
    rows, vocab = frames(spark, streams)
    run = drift.drift_adaptive if adaptive else drift.drift_fixed
    got = logged(run(rows, vocab, settings))
    want = {i: plain_drift(c, h, settings) for i, (c, h) in enumerate(streams)}
    assert got == {i: w for i, w in want.items() if w}
    if adaptive:
        assert sum(row[5] for row in want[0]) > 1  # the fixture does move the static window
        assert max(row[4] for row in want[1]) > settings.cold_start


def test_adaptive_with_frozen_length_equals_fixed_until_the_first_move(spark):
    settings = drift.DriftSettings(adaptive=True, gap=2.0, p_grow=2.0, p_shrink=-1.0, **SMALL)
    rows, vocab = frames(spark, [make_stream(200, 4, 5, 60)])
    log = logged(drift.drift_adaptive(rows, vocab, settings))[0]
    # The forced trigger moves the static window to rows 1..20; nothing moves afterwards.
    counts, hits = make_stream(200, 4, 5, 60)
    for index, acc, x, p, used, hit in log[1:]:
        want = plain_chi2(counts[1:21].sum(0), counts[index - 20:index].sum(0), 3)
        assert (x, p, used, hit) == (round(want[0], 6), round(want[1], 6), 20, 0)


def test_length_limits():
    settings = drift.DriftSettings()
    assert settings.reach == 2001

    class Flat:
        """Windows which never differ, or always do."""

        def __init__(self, own, same):
            self.own, self.same = own, same

        def totals(self, low, high):
            pair = [100, 100] if self.same or np.max(high) <= 500 else [10, 900]
            return np.array([pair] * len(high)) if np.ndim(high) else np.array(pair)

        def accuracy(self, low, high):
            return np.ones(len(high)) if np.ndim(high) else 1.0

    parts = []
    drift._walk(Flat(np.arange(5000), True), None, settings, parts)
    log = drift._log_frame(parts, 0)
    first = log.iloc[0]
    assert (first["index"], first["window_rows"], first["triggered"]) == (501, 500, 1)  # forced
    assert log["window_rows"].max() == 2001 and len(log) == 4500
    parts = []
    state = {"static_from": 0, "static_to": 500, "length": 502, "static_accuracy": 1.0, "static_terms": np.array([100, 100])}
    drift._walk(Flat(np.arange(600, 610), False), state, settings, parts)
    assert list(drift._log_frame(parts, 0)["window_rows"])[:4] == [502, 501, 500, 500]


def test_model_epochs(spark):
    log = spark.createDataFrame(
        [(0, 501, 500, 501, 1), (0, 502, 501, 502, 0), (0, 700, 600, 599, 1), (1, 501, 500, 501, 1)],
        "shard long, index long, window_rows int, next_rows int, triggered int",
    )
    got = sorted(tuple(r) for r in drift.model_epochs(log).select("shard", "version", "train_from", "train_to", "used_to").collect())
    assert got == [(0, 1, 0, 501, 700), (0, 2, 101, 700, None), (1, 1, 0, 501, None)]


@pytest.mark.parametrize("dof,want", [(100_000, 0.6911), (200_000, 0.6912)])
def test_tail_of_many_degrees(dof, want):
    # half a standard deviation below the mean, where the normal approximation is close
    x = dof - 0.5 * math.sqrt(2 * dof)
    cube = ((x / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    assert chi2_tail([x], [dof])[0] == pytest.approx(0.5 * math.erfc(cube / math.sqrt(2)), abs=1e-6)
    assert chi2_tail([x], [dof])[0] == pytest.approx(want, abs=3e-3)


def test_tail_does_not_hang_on_the_values_beside_it():
    rng = np.random.default_rng(5)
    dof = rng.integers(1, 300, 3000)
    x = dof * rng.uniform(0.2, 2.5, 3000)
    assert chi2_tail(x, dof).tolist() == [chi2_tail(a, b)[0] for a, b in zip(x, dof)]


def test_adaptive_walk_takes_as_many_jobs_for_many_blocks_as_for_few(spark):
    def jobs(n, group):
        rows, vocab = frames(spark, [make_stream(n, 4, 9, 40)])
        spark.sparkContext.setJobGroup(group, group)
        try:
            settings = drift.DriftSettings(cold_start=20, max_rows=60, min_count=3, block_rows=70)
            log = logged(drift.drift_adaptive(rows, vocab, settings))[0]
        finally:
            spark.sparkContext.setJobGroup("", "")
        assert len(log) == n - 20
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(1400, "twenty blocks") <= jobs(140, "two blocks")
