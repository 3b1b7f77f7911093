import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_dedup import brute


def test_stages(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "", None, None, 0), (9003, "12 !", "de", "src2", 4), (None, "Ein Satz ohne Nummer steht hier", None, None, 31), (9004, "Ein anderer Satz steht hier allein", "de", None, 33)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = base.unionByName(extra).withColumns({"score": F.lit("clash"), "row": F.lit(2)})
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, docs, "")
    kept = {r["doc_id"] for r in first.select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()} - {9001, 9002, 9003} and first.columns == docs.columns
    second = stages["near_dedup"](spark, first, "")
    want = {k for k, (_, c) in brute([(r["doc_id"], r["text"]) for r in first.collect() if r["doc_id"] is not None], 5).items() if k == c} | {None}
    got = [r["doc_id"] for r in second.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and second.columns == docs.columns
    third = stages["mix"](spark, second, "")
    assert third.columns == docs.columns and set(r["doc_id"] for r in third.collect()) <= want
    fourth = stages["encode"](spark, third, "")
    assert fourth.count() == third.count() and fourth.filter("n_tokens <> size(token_ids)").count() == 0


def test_empty_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
