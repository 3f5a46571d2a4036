import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.corpus import documents
from tidemark.llm import lang_id, simhash
from tidemark.plans.staging import stage


def test_every_stage_decides_over_what_came_before(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, folder), "test")
        assert docs.columns == columns, name
        kept.append(docs)
    source = spark.read.parquet(f"{folder}/documents.parquet")
    named, unique, clean, mixed = kept
    # nothing without a language; labels are those predicted
    profiles = lang_id.learn_profiles(source.filter(~lang_id.held_out_fold(F.col("doc_id"))))
    predicted = lang_id.identify(source, profiles).filter("lang_pred != 'und'").select("doc_id", "lang_pred")
    assert sorted(map(tuple, named.select("doc_id", "lang").collect())) == sorted(map(tuple, predicted.collect()))
    # one document of each group
    groups = simhash.near_duplicates(named)
    assert sorted(r.doc_id for r in unique.collect()) == sorted({r.component_id for r in groups.collect()})
    assert unique.count() < named.count()
    # contaminated documents go, others stay
    marked = corpus_pipeline.contamination(unique, spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in marked.filter("not contaminated").collect())
    assert clean.count() < unique.count()
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    shards = corpus_pipeline.STAGES[-1][1](spark, mixed, folder).collect()
    assert sorted(r.doc_id for r in shards) == sorted(r.doc_id for r in mixed.collect())
    ordered = sorted(shards, key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(ordered, ordered[1:], strict=False))


def test_texts_without_known_ngrams_go(spark, folder):
    source = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(-5, "ꙮꙮꙮ ꙮꙮ", "en", "src1", 6)], source.schema)
    named = corpus_pipeline.language(spark, source.unionByName(odd), folder)
    assert named.filter("doc_id = -5").count() == 0 and named.count() > 0.9 * source.count()


@pytest.mark.parametrize("rows", [None, []])
def test_awkward_rows(spark, tmp_path, rows):
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such words")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert (set(found) <= {1, 6, 7, 10, None} and 7 in found) if rows is None else found == []
