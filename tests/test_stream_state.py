"""The state of the running features: few calls a key, whatever its days, and the rows of plain loops."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from tidemark.operators.exact_sums import ExactSum, running_sums
from tidemark.streaming import features as S


class Store:
    """A value or a map state which counts its calls."""

    def __init__(self, calls):
        self.kept, self.calls = {}, calls

    def _call(self):
        self.calls.append(1)

    def get(self):
        self._call()
        return self.kept.get(None)

    def update(self, value):
        self._call()
        self.kept[None] = value

    def getValue(self, key):
        self._call()
        return self.kept[key]

    def updateValue(self, key, value):
        self._call()
        self.kept[key] = value

    def removeKey(self, key):
        self._call()
        del self.kept[key]


class Handle:
    def __init__(self):
        self.calls, self.timers, self.states = [], set(), {}

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Store(self.calls))

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls.append(1)
        self.timers.add(at)


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


BEGIN = pd.Timestamp("2024-01-01")


def frame(rows):
    return pd.DataFrame(rows, columns=["review_id", "event_time", "fake", "week", "x"])


def made_rows(n, days, seed=3):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        at = BEGIN + pd.Timedelta(microseconds=draw.randrange(days * S.BUCKET))
        rows.append((i, at, draw.choice([0, 1, None]), f"2024-{at.dayofyear // 7:02d}", draw.choice([None, draw.random() * 10, 0.1])))
    return rows


def run(batches, last_day):
    """Micro-batches, and the watermark behind each; all timers which are due are called."""
    handle, out = Handle(), []
    state = S.RunningFeatures(["user_id"], ["x"], "user")
    state.init(handle)
    for rows, day in [*batches, ([], last_day)]:
        at = int((BEGIN + pd.Timedelta(days=day)).value // 1_000_000)
        list(state.handleInputRows((7,), iter([frame(rows)] if rows else []), Now(at)))
        for timer in sorted(t for t in handle.timers if t <= at):
            handle.timers.discard(timer)
            out += list(state.handleExpiredTimer((7,), Now(at), None))
    assert not handle.timers and not handle.states["waiting"].kept
    return pd.concat(out, ignore_index=True), len(handle.calls)


def looped(rows):
    total, fakes, weeks, out = ExactSum(), 0, set(), []
    for n, (i, _, fake, week, x) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        fakes += fake or 0
        weeks.add(week)
        if x is not None:
            total.add(x)
        mean = None if x is None else total.value() / n
        out.append((i, mean, mean is None or not mean > x, n, int(fake is not None and fakes > 1), len(weeks), n / len(weeks)))
    return out


def plain(table):
    found = table.drop(columns="user_id").itertuples(index=False)
    return [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in found]


def test_few_calls_a_key():
    """A row of its own day took some five calls; 200 rows of 60 days were over 300."""
    rows = made_rows(200, 60)
    found, calls = run([(rows, 0)], 70)
    assert plain(found) == looped(rows) and calls < 15


@pytest.mark.parametrize("part,released", [(1, 1), (3, 10), (1_000, 10_000)])
def test_watermark_moves_through_parts(monkeypatch, part, released):
    monkeypatch.setattr(S, "PART", part)
    monkeypatch.setattr(S, "RELEASED", released)
    rows = made_rows(300, 20)
    # each batch brings rows of its day and of up to four days to come; the watermark follows
    dealt = [[r for r in rows if max(0, r[1].dayofyear - 1 - r[0] % 5) == k] for k in range(20)]
    found, _ = run([(own, day) for day, own in enumerate(dealt)], 25)
    assert plain(found) == looped(rows)


@pytest.mark.parametrize("kind", ["whole", "cents", "shares", "tiny", "huge", "mixed", "infinite"])
def test_running_sums_equal_one_by_one(kind):
    draw = random.Random(kind)
    made = {
        "whole": lambda: draw.randint(-5, 5), "cents": lambda: draw.randint(-(10**7), 10**7), "shares": lambda: draw.choice([1 / 3, -0.7, 16383.9, 1e-3]) * draw.random(),
        "tiny": lambda: draw.random() * 1e-19, "huge": lambda: draw.random() * 1e25, "mixed": lambda: draw.choice([1.0, 0.1, 1e20, 1e-20]),
        "infinite": lambda: draw.choice([1.0, 0.5, math.inf] + [-math.inf] * (draw.random() < 0.02)),
    }[kind]
    total, kept = ExactSum(), ExactSum()
    for size in (0, 1, 50, 700):
        values = np.array([math.nan if draw.random() < 0.1 else float(made()) for _ in range(size)])
        want = []
        for v in values:
            if not math.isnan(v):
                total.add(v)
            want.append(total.value())
        got, kept = running_sums(values, kept)
        assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(got.tolist(), want, strict=True))


def test_shares_after_whole_numbers_and_back():
    kept, total = ExactSum(), ExactSum()
    for values in ([1.0, 2.0], [0.1, 0.2], [5.0, 7.0], [1e30], [0.25]):
        got, kept = running_sums(np.array(values), kept)
        for v in values:
            total.add(v)
        assert got[-1] == total.value() == kept.value()
