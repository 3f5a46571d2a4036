import functools
import math
import operator

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import neighbours


def best(rows, wanted, k):
    """The ``k`` best of each query, over all rows."""
    found = {}
    for key, vector in wanted:
        scores = [(-float((np.array(v) * np.array(vector)).sum()), other) for other, v in rows if other != key]
        found[key] = [o for _, o in sorted(scores)[:k]]
    return found


def test_chi_square_quantile():
    # known values of the distribution
    assert math.isclose(neighbours.chi_square_quantile(0.95, 8), 15.50731, abs_tol=1e-4)
    assert math.isclose(neighbours.chi_square_quantile(0.5, 2), 2 * math.log(2), abs_tol=1e-9)


@pytest.mark.parametrize("block, queries", [(100_000, 1024), (150, 7)])
def test_recall_against_brute_force(spark, folder, block, queries):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    found = neighbours.nearest(table, F.col("vec_id") % 20 == 0, 20, block=block, queries=queries).collect()
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in table.collect()]
    truth = best(rows, [r for r in rows if r[0] % 20 == 0], 20)
    own = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        own.setdefault(r.query_id, []).append(r)
    assert own.keys() == truth.keys()
    assert all([r.rank for r in rs] == list(range(1, 21)) for rs in own.values())
    hits = sum(len({r.vec_id for r in own[q]} & set(truth[q])) for q in truth)
    assert hits >= 0.9 * 20 * len(truth)
    vectors = dict(rows)
    for r in found:
        assert r.score == functools.reduce(operator.add, (vectors[r.query_id] * vectors[r.vec_id]).tolist(), 0.0)
    assert all(list(map(lambda r: (-r.score, r.vec_id), rs)) == sorted((-r.score, r.vec_id) for r in rs) for rs in own.values())


def test_several_indexes_in_a_partition(spark, folder, monkeypatch):
    monkeypatch.setattr(neighbours, "TASKS", 8)
    monkeypatch.setattr(neighbours, "PARTITIONS", 5)
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    wanted = F.col("vec_id") % 10 == 0
    few = neighbours.nearest(table, wanted, 5, block=50, queries=2).orderBy("query_id", "rank").collect()
    monkeypatch.undo()
    assert few == neighbours.nearest(table, wanted, 5).orderBy("query_id", "rank").collect()


def test_unusable_rows_copies_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]),
        (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 0.0]), (9, [-1.0, 0.0]), (None, [5.0, 0.0]), (10, [1.0, 1.0, 1.0]),
        (20, []),
    ]
    rows += [(k, [1.0, 0.0]) for k in range(100, 160)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    df = df.select("*", F.lit("x").alias("score"), F.lit("x").alias("vector"), F.lit("x").alias("dim"), F.lit("x").alias("block"))
    found = neighbours.nearest(df, F.col("vec_id") == 0, 4, block=20).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [
        (0, 1, 2, 2.0), (0, 2, 1, 1.0), (0, 3, 8, 1.0), (0, 4, 100, 1.0)
    ]
    everything = neighbours.nearest(df.filter("vec_id < 10"), F.col("vec_id") == 9, 20).orderBy("rank").collect()
    assert [r.vec_id for r in everything] == [0, 1, 8, 2]
    assert neighbours.nearest(df.filter("vec_id = -1"), F.col("vec_id") == 0, 4).count() == 0
    assert neighbours.nearest(df, F.col("vec_id") == 3, 4).count() == 0
