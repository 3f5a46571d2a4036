"""Blocked scans equal plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.scan import running, with_halo, with_position


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    # One key holds more than a third of all rows, and one moment many of them.
    made = [
        (i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", rng.randrange(15), rng.randrange(100))
        for i in range(3000)
    ]
    rng.shuffle(made)
    return spark.createDataFrame(made, "id long, key string, at int, x long").repartition(7)


def as_set(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("group", [(), ("key",)])
def test_position_equals_row_number(rows, group):
    made = with_position(rows, ["at", "id"], group)
    w = Window.partitionBy(*group)
    plain = rows.select(
        "id",
        (F.row_number().over(w.orderBy("at", "id")) - 1).cast("bigint").alias("pos"),
        F.count(F.lit(1)).over(w).alias("group_rows"),
    )
    assert as_set(made, "id", "pos", "group_rows") == as_set(plain, "id", "pos", "group_rows")


@pytest.mark.parametrize("group", [(), ("key",)])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_window(rows, group, inclusive):
    placed = with_position(rows, ["at", "id"], group)
    made = running(
        placed,
        {"s": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("x"))},
        group, inclusive=inclusive, block_rows=64,
    )
    end = 0 if inclusive else -1
    w = Window.partitionBy(*group).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, end)
    plain = rows.select(
        "id", F.coalesce(F.sum("x").over(w), F.lit(0)).alias("s"),
        F.coalesce(F.min("x").over(w), F.lit(-1)).alias("lo"),
        F.coalesce(F.max("x").over(w), F.lit(-1)).alias("hi"),
    )
    made = made.select(
        "id", "s", F.coalesce("lo", F.lit(-1)).alias("lo"), F.coalesce("hi", F.lit(-1)).alias("hi")
    )
    assert as_set(made, "id", "s", "lo", "hi") == as_set(plain, "id", "s", "lo", "hi")


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, key string")
    made = with_position(df, ["id"], ["key"])
    assert as_set(made, "id", "pos") == [(1, 0), (2, 1), (3, 0)]


def test_halo_copies_only_the_end_of_a_block(spark):
    df = spark.range(25).withColumnRenamed("id", "pos")
    made = with_halo(df, 3, block_rows=10).where("halo")
    assert as_set(made, "pos", "block") == [(7, 1), (8, 1), (9, 1), (17, 2), (18, 2), (19, 2)]
    with pytest.raises(ValueError):
        with_halo(df, 11, block_rows=10)
