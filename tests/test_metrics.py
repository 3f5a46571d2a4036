import pytest
from pyspark.sql import functions as F

from tidemark.operators import bayes, filters, grid, hoeffding, metrics, windows
from tidemark.plans.scan import with_position
from tidemark.registry.common import reviews


@pytest.fixture(scope="module")
def preds(spark):
    return spark.createDataFrame(
        [(0, "fake", "fake"), (0, "fake", "nofake"), (0, "nofake", "nofake"), (0, "nofake", None),
         (1, "nofake", "nofake"), (1, "nofake", "fake")],
        "shard long, y string, y_pred string",
    )


def test_pooled_and_per_shard(preds):
    got = {r["shard"]: r for r in metrics.shard_metrics(preds).collect()}
    assert sorted(got) == [-1, 0, 1]
    assert got[-1]["accuracy"] == pytest.approx(4 / 6)
    assert got[0]["recall_fake"] == 0.5 and got[0]["precision_fake"] == 1.0
    # Shard 1 has no fakes: scores which are not defined are 0.
    assert got[1]["recall_fake"] == 0.0 and got[1]["f1_fake"] == 0.0
    assert got[-1]["f1_fake"] == pytest.approx(2 * 1 / (2 + 2))


def test_confusion_and_line(preds):
    got = {r["y"]: (r["pred_nofake"], r["pred_fake"]) for r in metrics.confusion_matrix(preds).collect()}
    assert got == {"fake": (1, 1), "nofake": (3, 1)}
    row = metrics.report_line(preds, "htc", 1.234).first()
    assert row["latex"].startswith("\\textsc{htc} & 66.67 & ") and row["latex"].endswith(" & 1.23\\\\")


def test_grids():
    trees = grid.combinations(grid.RANGES["htc"])
    assert len(trees) == 72 and len(grid.combinations(grid.RANGES["arfc"])) == 8
    assert (trees[1]["max_depth"], trees[1]["remove_poor_attrs"]) == (1, False)
    assert grid.combinations(grid.RANGES["htc"])[0] == grid.START["htc"]


def plain_nb(rows, features, floor=bayes.VAR_FLOOR):
    import math

    seen, out = {"nofake": [], "fake": []}, []
    for row in rows:
        vote = "nofake"
        if all(seen.values()):
            score = {}
            for label, past in seen.items():
                s = math.log(len(past))
                for f in features:
                    xs = [p[f] for p in past]
                    m = sum(xs) / len(xs)
                    v = max(sum(x * x for x in xs) / len(xs) - m * m, floor)
                    s -= 0.5 * math.log(v) + (row[f] - m) ** 2 / (2 * v)
                score[label] = s
            vote = "fake" if score["fake"] > score["nofake"] else "nofake"
        out.append(vote)
        seen[row["label"]].append(row)
    return out


def test_naive_bayes_equals_a_loop(spark, folder):
    placed = with_position(reviews(spark, folder), ["ts", "review_id"])
    rows = [r.asDict() for r in placed.orderBy("pos").collect()]
    made = bayes.prequential(placed, ["cents", "rating"], block_rows=90).orderBy("pos").collect()
    assert [r["y_pred"] for r in made] == plain_nb(rows, ["cents", "rating"])


def test_best_candidate_prefers_the_earlier(spark):
    scores = spark.createDataFrame(
        [(0, 0, 5, 10, 0.5), (0, 1, 7, 10, 0.7), (0, 2, 7, 10, 0.7)],
        "shard int, grid_pos int, hits long, n long, accuracy double",
    )
    assert bayes.best_candidate(scores, ["shard"]).first()["grid_pos"] == 1


def test_hoeffding_prefers_the_telling_feature(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, "fake").otherwise("nofake").alias("label"),
        (F.col("id") % 2).alias("good"), (F.col("id") % 7).alias("noise"),
    )
    got = {r["feature"]: r for r in hoeffding.split_decision(df, {"good": F.col("good"), "noise": F.col("noise")}).collect()}
    assert got["good"]["gain"] == pytest.approx(1.0) and got["good"]["split"] and not got["noise"]["split"]


def test_sliding_mean_over_blocks(spark):
    hits = [(i * 7) % 3 == 0 for i in range(200)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hits)], "pos long, hit boolean")
    made = windows.sliding_mean(df, F.col("hit"), 25, "acc", block_rows=30).orderBy("pos").collect()
    want = [sum(hits[max(0, i - 24): i + 1]) / len(hits[max(0, i - 24): i + 1]) for i in range(200)]
    assert [r["acc"] for r in made] == pytest.approx(want)


def test_filters(spark):
    df = spark.createDataFrame([(1, None, None, True), (2, "a", 2.0, None)], "id int, t string, x double, b boolean")
    rows = filters.fill_missing(df, ["t"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "", 0.0, True), (2, "a", 2.0, False)]
    assert filters.matching_columns(df, "x") == ["x"]
    assert filters.select_features(df, ["b"]).first()[0] == 1.0
    kept = {r["feature"]: r["kept"] for r in filters.varying_features(df, ["id", "x"]).collect()}
    assert kept == {"id": True, "x": False}
    with pytest.raises(ValueError):
        filters.rating_class(df, 3)


def test_naive_bayes_on_large_and_constant_numbers(spark):
    import random

    rng, big = random.Random(4), 4_000_000_000
    rows = []
    for pos in range(300):
        y = rng.random() < 0.5
        rows.append((pos, "fake" if y else "nofake", big + (3 if y else 0) + rng.randint(0, 1), 7))
    df = spark.createDataFrame(rows, "pos long, label string, x long, c long").withColumn("review_id", F.col("pos"))
    for features in (["x"], ["x", "c"]):
        made = bayes.prequential(df, features).where("pos >= 20")
        # three apart with a spread of one: right every time, however far from zero
        assert made.where("y != y_pred").count() == 0
