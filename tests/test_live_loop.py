"""The closed loop on a stream against the batch walk over the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_closed_loop import CANDIDATES, FEATURES, make
from tidemark.operators import closed_loop, drift
from tidemark.streaming import live_loop as live
from tidemark.streaming.features import state_settings
from tidemark.streaming.source import row_stream

SETTINGS = drift.DriftSettings(cold_start=20, max_rows=60, min_count=3)
SCHEMA = (
    "shard long, pos long, label string, a double, b double, c double, term_ids array<int>, term_counts array<int>, grams array<string>"
)


def table():
    rows = []
    for shard, own in {0: make(260, 1), 1: make(170, 2), 2: make(12, 3)}.items():
        for r in own:
            grams = [f"t{i}" for i, n in enumerate(r[5]) for _ in range(n)]
            rows.append((shard, *r[:5], list(range(4)), r[5], grams))
    return rows


def plain(df):
    return sorted(map(str, df.select(*closed_loop.WALK.names).collect()))


def write(spark, rows, path, files):
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("append").parquet(path)


@pytest.mark.parametrize("adaptive, compare_to", [(True, "current"), (False, "initial")])
def test_stream_equals_the_batch_walk(spark, tmp_path, adaptive, compare_to):
    state_settings(spark)
    settings = drift.DriftSettings(adaptive=adaptive, cold_start=20, max_rows=60, min_count=3)
    rows, path = table(), str(tmp_path / "rows")
    # rows of all positions in every file, so that most of them come before their turn
    write(spark, rows, path, 4)
    vocab = spark.createDataFrame([(s, f"t{i}") for s in range(3) for i in range(4)], "shard long, term string")
    batch = closed_loop.walk(spark.createDataFrame(rows, SCHEMA), vocab, FEATURES, CANDIDATES, settings, compare_to)
    schema = spark.createDataFrame([], SCHEMA).schema
    found = live.replayed(row_stream(spark, path, schema, 1), FEATURES, CANDIDATES, settings, compare_to, width=4)
    assert plain(found) == plain(batch) and found.where("late = 1").count() == 0
    assert closed_loop.drift_log(found).count() == closed_loop.drift_log(batch).count() > 0


def test_restart_late_rows_and_a_batch_run_twice(spark, tmp_path):
    state_settings(spark)
    rows, path = table(), str(tmp_path / "rows")
    folder, state = str(tmp_path / "out"), str(tmp_path / "state")
    schema = spark.createDataFrame([], SCHEMA).schema
    walked = lambda: live.live_loop(row_stream(spark, path, schema, 2), FEATURES, CANDIDATES, SETTINGS, width=4)
    write(spark, [r for r in rows if r[1] < 100], path, 2)
    live.run_to_end(walked(), folder, state)
    half = live.read_live(spark, folder).count()
    # a restart from the checkpoint, with rows which have had their turn and some without shard or position
    twice = random.Random(1).sample([r for r in rows if r[1] < 100], 17)
    odd = [(None, *rows[0][1:]), (0, None, *rows[0][2:])]
    write(spark, [r for r in rows if r[1] >= 100] + twice + odd, path, 1)
    live.run_to_end(walked(), folder, state)
    live.run_to_end(walked(), folder, state)
    found = live.read_live(spark, folder)
    vocab = spark.createDataFrame([(s, f"t{i}") for s in range(3) for i in range(4)], "shard long, term string")
    batch = closed_loop.walk(spark.createDataFrame(rows, SCHEMA), vocab, FEATURES, CANDIDATES, SETTINGS)
    assert half == sum(r[1] < 100 for r in rows) and plain(found.where("late = 0")) == plain(batch)
    late = {(r.shard, r.pos): r.times for r in live.late_rows(found).collect()}
    assert late == {(r[0], r[1]): 1 for r in twice}
    # the same batch again: its folder is replaced
    part = spark.createDataFrame(found.where("shard = 1").collect(), found.schema)
    before = found.count()
    for _ in range(2):
        live.once(folder)(part, 99)
    assert live.read_live(spark, folder).count() == before + part.count()


def test_vocabulary_made_in_the_state(spark, tmp_path):
    """Terms which too few or too many of the first rows hold are no terms."""
    state_settings(spark)
    rows = []
    for r in table():
        extra = ["always"] + (["rare"] if r[1] == 3 else [])
        rows.append((*r[:8], r[8] + extra))
    path = str(tmp_path / "rows")
    write(spark, rows, path, 3)
    schema = spark.createDataFrame([], SCHEMA).schema
    found = live.replayed(row_stream(spark, path, schema, 1), FEATURES, CANDIDATES, SETTINGS, min_df=0.1, max_df=0.7)
    cold = {s: [set(r[8]) for r in rows if r[0] == s and r[1] < 20] for s in range(3)}
    kept = {s: [t for t in sorted(set().union(*own)) if 0.1 * len(own) <= sum(t in g for g in own) <= 0.7 * len(own)] for s, own in cold.items()}
    assert all("always" not in own and "rare" not in own for own in kept.values()) and kept[0] and kept[1]
    numbered = []
    for r in rows:
        own = [(kept[r[0]].index(t), r[8].count(t)) for t in sorted(set(r[8])) if t in kept[r[0]]]
        numbered.append((*r[:6], [i for i, _ in own], [n for _, n in own], None))
    vocab = spark.createDataFrame([(s, t) for s, own in kept.items() for t in own], "shard long, term string")
    batch = closed_loop.walk(spark.createDataFrame(numbered, SCHEMA), vocab, FEATURES, CANDIDATES, SETTINGS)
    assert plain(found) == plain(batch)
    assert found.where(F.col("n_terms") > 0).count() > 0


def test_bad_settings_are_refused(spark):
    with pytest.raises(ValueError):
        live.live_loop(spark.createDataFrame([], SCHEMA), FEATURES, CANDIDATES, compare_to="other")
