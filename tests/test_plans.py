"""What the plans must look like to hold at scale."""

from pyspark.sql import functions as F

from tidemark.operators.running import entity_features
from tidemark.plans.scan import running, with_position
from tidemark.registry import rows, text
from tidemark.registry.common import reviews


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange_per_entity(spark, folder):
    made = entity_features(reviews(spark, folder), ["user_id"], "user", ["cents", "rating"])
    shown = plan(made)
    assert shown.count("Exchange hashpartitioning") == 1
    # Row numbers within the week, then everything else in one window.
    assert shown.count("Window [") == 2 and shown.count("RunningWindowFunction") <= 2


def test_rating_reuses_the_product_exchange(spark, folder):
    product = entity_features(reviews(spark, folder), ["product_id"], "product", ["cents"])
    both = entity_features(
        product, ["product_id", "rating"], "rating", ["cents"], partition_by=["product_id"]
    )
    assert plan(both).count("Exchange hashpartitioning") == 1


def test_no_scan_in_a_single_task(spark, folder):
    for query in (rows.shard_split, rows.sliding_accuracy, rows.running_variance):
        shown = plan(query(spark, folder))
        for line in shown.splitlines():
            # The only single-partition exchange carries one row per range or block.
            if "Exchange SinglePartition" in line:
                rest = shown[shown.index(line):].splitlines()[1:4]
                assert any("HashAggregate" in r or "-parts-" in r for r in rest), shown


def test_columns_are_pruned(spark, folder):
    assert "props" not in plan(rows.label_counts(spark, folder))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(text.word_count(spark, folder))


def test_positions_read_a_written_table(spark, folder):
    placed = with_position(reviews(spark, folder), ["ts", "review_id"])
    assert "rangepartitioning" not in plan(placed)


def test_running_shuffles_the_rows_once(spark, folder):
    placed = with_position(reviews(spark, folder), ["ts", "review_id"])
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        shown = plan(running(placed, {"s": ("sum", F.col("cents"))}))
    finally:
        spark.conf.set(setting, before)
    # The rows by block, their partial totals, and the carries: one row per block each.
    assert shown.count("Exchange hashpartitioning(_block") == 3, shown
    assert "SortMergeJoin [_block" in shown and "coalesce(_block" not in shown
