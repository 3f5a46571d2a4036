"""Drawn and placed before they are wide: the same rows as features, balance and shards one after the other."""

import datetime
import os
import random

from pyspark.sql import functions as F

from tidemark.operators.running import incremental_features
from tidemark.plans.pipeline import balanced_features, balanced_shards
from tidemark.plans.staging import passing, shared_folder, stage
from tidemark.schemas import TEXT_MEASURES


def table(spark, n=700):
    draw, rows = random.Random(5), []
    for i in range(n):
        ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=draw.randrange(1200))
        some = lambda v: None if draw.random() < 0.04 else v
        rows.append((i, some(draw.randrange(30)), some(draw.randrange(9)), some(draw.randrange(7)), ts,
                     some("fake" if draw.random() < 0.3 else "nofake"), draw.randrange(20), some(draw.randrange(90)),
                     *[some(draw.choice((0.0, 1 / 3, draw.gauss(0, 1)))) for _ in TEXT_MEASURES]))
    measures = ", ".join(f"{m} double" for m in TEXT_MEASURES)
    return spark.createDataFrame(rows, f"review_id long, user_id long, product_id int, rating int, ts timestamp_ntz, label string, doc_id long, word_count int, {measures}")


def listed(df, columns):
    return sorted(str(r) for r in df.select(*columns).collect())


def folders(spark):
    held = f"{shared_folder(spark).removeprefix('file:')}/tidemark/{spark.sparkContext.applicationId}"
    return set(os.listdir(held)) if os.path.isdir(held) else set()


def test_same_rows_as_step_by_step(spark):
    source = stage(table(spark), "test-reviews")
    # some products are hot keys, the users are not
    want = balanced_shards(stage(incremental_features(source, hot_rows=60), "test-features"), 3)
    before = folders(spark)
    made = balanced_features(source, 3, hot_rows=60)
    left = [f.rsplit("-", 1)[0] for f in folders(spark) - before]
    assert left == ["balanced-shards"]  # nothing else stays on disk
    assert set(made.columns) == set(want.columns) and 100 < made.count() < 700
    assert listed(made, want.columns) == listed(want, want.columns)


def test_rows_which_are_not_drawn_are_narrow(spark):
    source = stage(table(spark).withColumn("wanted", F.col("review_id") % 3 == 0), "test-reviews")
    whole = incremental_features(source).where("wanted")
    some = incremental_features(source, only="wanted")
    assert listed(some, whole.columns) == listed(whole, whole.columns)
    shown = some._jdf.queryExecution().executedPlan().toString()
    # sums are cut into limbs after the exchange
    exchanges = [line for line in shown.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("_sum_" in line for line in exchanges)


def test_passing_tables_go_and_lasting_ones_stay(spark):
    before = folders(spark)
    with passing(spark):
        stage(spark.range(3).toDF("x"), "test-passing")
        kept = stage(spark.range(5).toDF("x"), "test-lasting", lasting=True)
    assert [f.rsplit("-", 1)[0] for f in folders(spark) - before] == ["test-lasting"] and kept.count() == 5
