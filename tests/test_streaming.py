"""A stream in several micro-batches, out of order, equals the batch operator."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.running import entity_features, incremental_features
from tidemark.registry.common import reviews
from tidemark.schemas import ENTITIES, EVENTS, REVIEWS, TEXT_MEASURES, running_columns
from tidemark.streaming.features import entities_to_end, features_to_end, state_settings
from tidemark.streaming.late import part_late_rows, parting
from tidemark.streaming.source import replay_table, row_stream


def test_row_stream_reads_every_row_once(spark, folder, tmp_path):
    path = str(tmp_path / "events")
    source = spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet")
    source.repartition(5).write.parquet(path)
    got = replay_table(row_stream(spark, path, EVENTS, files_per_batch=2))
    assert sorted(r[0] for r in got.select("event_id").collect()) == sorted(
        r[0] for r in source.select("event_id").collect()
    )


@pytest.mark.parametrize("keys,suffix", [(["user_id"], "user"), (["product_id", "rating"], "rating")])
def test_stream_equals_batch(spark, folder, tmp_path, keys, suffix):
    state_settings(spark)
    # Fractions of all sizes, so that a sum of doubles would hang on its order.
    share = F.col("cents") / F.lit(137.0)
    sizes = F.when(F.col("review_id") % 5 == 0, share * 1e25).when(F.col("review_id") % 5 == 1, share * 1e-19).otherwise(share)
    source = reviews(spark, folder).where("review_id < 300").withColumn("share", sizes)
    path = str(tmp_path / "rows")
    # Five files, each with rows of the whole time span, and missing numbers and labels.
    holed = source.withColumns(
        {
            "cents": F.when(F.col("review_id") % 7 != 0, F.col("cents")),
            "label": F.when(F.col("review_id") % 11 != 0, F.col("label")),
            "share": F.when(F.col("review_id") % 13 != 0, F.col("share")),
        }
    )
    holed.repartition(5).write.parquet(path)

    def close():
        far = datetime.datetime(2200, 1, 1)
        mark = [(-1, -1, -1, 5, far, None, None, None, None)]
        spark.createDataFrame(mark, schema).coalesce(1).write.mode("append").parquet(path)

    schema = T.StructType([*REVIEWS.fields, T.StructField("share", T.DoubleType())])
    measures = ["cents", "rating", "share"]
    # The delay covers the span: no row is late.
    made = features_to_end(
        lambda: row_stream(spark, path, schema, files_per_batch=2), keys, suffix, measures, close, "60 days"
    )
    names = [c for c in made.columns if c not in keys]
    got = sorted(map(str, made.where("review_id >= 0").select(names).collect()))
    batch = entity_features(holed, keys, suffix, measures)
    assert got == sorted(map(str, batch.select(names).collect())) and len(got) == 300


def measured(spark, folder, rows):
    """Reviews with all measures, fractions and nulls among them."""
    source = reviews(spark, folder).where(f"review_id < {rows}")
    made = {m: (F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(1000)) / F.lit(137.0)) for i, m in enumerate(("word_count", *TEXT_MEASURES))}
    made["urls"] = F.when(F.col("review_id") % 9 != 0, made["urls"])
    return source.withColumns(made)


def test_all_entities_and_measures_equal_the_batch(spark, folder, tmp_path):
    state_settings(spark)
    source, path = measured(spark, folder, 250), str(tmp_path / "rows")
    source.repartition(4).write.parquet(path)
    source = spark.read.schema(source.schema).parquet(path)

    def close():
        far = [(-1, -1, -1, 5, datetime.datetime(2200, 1, 1), None, None, None, *[None] * 20)]
        spark.createDataFrame(far, source.schema).coalesce(1).write.mode("append").parquet(path)

    batch = incremental_features(source)
    columns = ["review_id", *[c for s in ENTITIES for c in running_columns(s)]]
    want = sorted(map(str, batch.select(columns).collect()))
    made = entities_to_end(lambda: row_stream(spark, path, source.schema, 2), close, delay="60 days")
    got = sorted(map(str, made.where("review_id >= 0").select(columns).collect()))
    assert len(columns) == 140 and len(got) == 250 and got == want


def test_late_rows_have_a_table(spark, tmp_path):
    state_settings(spark)
    path, folder = str(tmp_path / "rows"), str(tmp_path / "parted")
    hour = datetime.timedelta(hours=1)
    begin = datetime.datetime(2024, 1, 1)
    schema = "review_id long, ts timestamp_ntz, user_id long, x double, label string"
    # Each file is a batch; a row is late if it is two days or more behind the files before its own.
    files, latest, late, late_marks = [], None, [], {}
    for k in range(5):
        rows = [(100 * k + i, begin + hour * (24 * k + i), i % 3, i / 7, "fake" if i % 4 == 0 else "nofake") for i in range(24)]
        if k >= 3:
            rows += [(100 * k + 50 + i, begin + hour * (i * 9), 1, 0.3, "nofake") for i in range(6)]
        if k == 4:
            rows += [(490, None, 1, 0.1, "fake")]
        for r in rows:
            if latest is not None and r[1] is not None and r[1] < latest - datetime.timedelta(days=2):
                late.append(r[0])
                late_marks[r[0]] = latest - datetime.timedelta(days=2)
        latest = max(r[1] for r in rows if r[1]) if latest is None else max(latest, *(r[1] for r in rows if r[1]))
        files.append(rows)
    parted = None
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        parted = part_late_rows(row_stream(spark, path, spark.createDataFrame([], schema).schema, 1), folder, delay="2 days")
    found = {r.review_id: r.watermark for r in parted.late(spark).collect()}
    assert late and found == late_marks
    on_time = [r.review_id for r in replay_table(parted.on_time(spark)).collect()]
    assert sorted([*on_time, *late]) == sorted(r[0] for rows in files for r in rows)
    # a batch which is run again changes nothing
    again = spark.createDataFrame(files[4], schema)
    parting(folder, "ts", "2 days")(again, 4)
    assert parted.late(spark).count() == len(late)

    # the features of the rows which were on time lose none of them
    def close():
        far = [(-1, datetime.datetime(2200, 1, 1), -1, None, None)]
        spark.createDataFrame(far, schema).coalesce(1).write.parquet(f"{folder}/rows/closing")

    made = features_to_end(lambda: parted.on_time(spark, 1), ["user_id"], "user", ["x"], close, "2 days")
    usable = {r[0] for rows in files for r in rows} - set(late)
    assert {r.review_id for r in made.where("review_id >= 0").collect()} == usable
