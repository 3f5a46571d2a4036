import pytest
from pyspark.sql import functions as F

from tidemark.operators.balance import balanced_union, split_shards, undersample
from tidemark.registry.common import reviews


def test_classes_become_equal(spark, folder):
    made = undersample(reviews(spark, folder), ["rating"])
    sizes = {}
    for r in made.groupBy("rating", "label").count().collect():
        sizes.setdefault(r["rating"], set()).add(r["count"])
    assert all(len(s) == 1 for s in sizes.values()) and len(sizes) == 5
    assert made.select("review_id").distinct().count() == made.count()


def test_smallest_class_is_kept_whole(spark, folder):
    source = reviews(spark, folder)
    fakes = source.where("rating = 5 and label = 'fake'").count()
    kept = balanced_union(source).where("rating = 5 and label = 'fake'").count()
    assert kept == fakes


def test_draw_depends_on_the_seed_only(spark, folder):
    source = reviews(spark, folder)
    ids = lambda df: {r[0] for r in df.select("review_id").collect()}
    assert ids(undersample(source, ["rating"])) == ids(undersample(source.repartition(5), ["rating"]))
    assert ids(undersample(source, ["rating"], seed=2)) != ids(undersample(source, ["rating"]))


def test_rows_without_label_or_rating_are_left_out(spark):
    df = spark.createDataFrame(
        [(1, 5, "fake"), (2, 5, None), (3, 5, "nofake"), (4, None, "fake"), (5, None, "nofake")],
        "review_id long, rating int, label string",
    )
    assert sorted(r[0] for r in balanced_union(df).select("review_id").collect()) == [1, 3]


@pytest.mark.parametrize("n", [7, 19, 20, 107])
def test_shards_are_contiguous_and_near_equal(spark, n):
    df = spark.range(n).select(
        F.col("id").alias("review_id"), F.timestamp_seconds(F.col("id") * 10).alias("ts")
    )
    rows = sorted(tuple(r) for r in split_shards(df).select("review_id", "shard", "pos").collect())
    shards = [r[1] for r in rows]
    assert shards == sorted(shards)
    sizes = [shards.count(k) for k in range(20)]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    for k in range(20):
        assert [r[2] for r in rows if r[1] == k] == list(range(sizes[k]))


def test_a_stratum_of_one_class_is_dropped(spark):
    rows = [(i, 1, "fake") for i in range(5)] + [(i, 2, "fake" if i % 3 else "nofake") for i in range(10, 19)]
    df = spark.createDataFrame(rows, "review_id long, s int, label string")
    got = undersample(df, ["s"]).collect()
    assert {r["s"] for r in got} == {2}
    assert sorted(r["label"] for r in got) == ["fake"] * 3 + ["nofake"] * 3
