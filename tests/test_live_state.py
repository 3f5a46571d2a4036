"""The state of the live closed loop: few calls whatever the order of the rows; what the walk tests without p-values."""

import random

import numpy as np
import pandas as pd
import pytest

from tests.test_closed_loop import CANDIDATES, FEATURES, SETTINGS, make, walked_in
from tests.test_stream_state import Handle, Store
from tidemark.functions.special import chi2_tail, tail_against
from tidemark.streaming import live_loop as live
from tidemark.streaming.source import state_partitions


class Kept(Store):
    def exists(self):
        return None in self.kept

    def containsKey(self, key):
        self._call()
        return key in self.kept


class State(Handle):
    def getValueState(self, name, *_):
        return self.states.setdefault(name, Kept(self.calls))

    getMapState = getValueState


def frame(rows):
    ids = [np.arange(4)] * len(rows)
    columns = {"place": [r[0] for r in rows], "y": [int(r[1] == "fake") for r in rows], "ids": ids, "counts": [np.array(r[5]) for r in rows]}
    return pd.DataFrame({**columns, **{f"x{k}": [r[2 + k] for r in rows] for k in range(3)}})


@pytest.mark.parametrize("order", ["backwards", "any", "odd first"])
def test_rows_ahead_wait_in_parts(order):
    rows = make(1200, 4)
    given = {"backwards": rows[::-1], "any": random.Random(2).sample(rows, len(rows)), "odd first": rows[1::2] + rows[::2]}[order]
    handle, loop = State(), live.LiveLoop(FEATURES, CANDIDATES, SETTINGS, False, 4, 0.1, 0.7)
    loop.init(handle)
    made = []
    for low in range(0, len(given), 150):
        made += list(loop.handleInputRows((0,), iter([frame(given[low : low + 150])]), None))
    # a row twice while it waits, and one whose turn has passed
    for more in ([(1300, *rows[0][1:])] * 2, [(1300, *rows[0][1:]), (5, *rows[5][1:])]):
        made += list(loop.handleInputRows((0,), iter([frame(more)]), None))
    assert len(handle.calls) < 120
    found = pd.concat(made)
    assert sorted(found[found["late"] == 1]["pos"]) == [5, 1300, 1300]
    want = pd.DataFrame(walked_in(1200, rows, SETTINGS))
    found = found[found["late"] == 0].drop(columns="late").reset_index(drop=True)
    for c in want.columns:
        assert [None if pd.isna(v) else v for v in found[c]] == [None if pd.isna(v) else v for v in want[c]], c


def test_state_has_no_more_partitions_than_cores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for given, wanted in (("100", "4"), ("3", "3")):
        spark.conf.set("spark.sql.shuffle.partitions", given)
        with state_partitions(spark):
            assert spark.conf.get("spark.sql.shuffle.partitions") == wanted
        assert spark.conf.get("spark.sql.shuffle.partitions") == given
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_side_of_a_level_without_the_tail():
    rng = np.random.default_rng(1)
    dof = rng.integers(0, 400, 5000)
    statistic = np.where(rng.random(5000) < 0.05, 0.0, dof + rng.normal(0, 3, 5000) * np.sqrt(2 * dof + 1)).clip(0)
    statistic[:3], dof[:3] = (np.nan, 1e6, 1e-30), (5, 5, 5)
    for level in (0.5, 0.1, 0.05, 1e-9, 0.0, 1.0):
        assert (tail_against(statistic, dof, level) == np.sign(chi2_tail(statistic, dof) - level)).all()
    assert not len(tail_against(np.zeros(0), np.zeros(0, int), 0.5))
