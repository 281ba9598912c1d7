"""The pipeline's stages on the smallest tables: each one's decisions, and the columns of documents throughout."""
from __future__ import annotations

import corpus_pipeline
from marketloom.llm import packing, quality, rules, simhash
from marketloom.llm.common import table

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    seen = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, DIR)
        seen[name] = (before, now)
        if name != "packing":
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
            now = now.cache()
    before, after = seen["quality_classifier"]
    good = {r["doc_id"] for r in quality.quality_scores(before, table(spark, DIR, "labels")).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == good
    before, after = seen["quality_rules"]
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == {r["doc_id"] for r in rules.quality_verdicts(before).filter("kept").collect()}
    before, after = seen["simhash_near_dedup"]
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == {r["component_id"] for r in simhash.near_duplicates(before).collect()}
    before, after = seen["substring_dedup"]
    assert before.count() == after.count() and after.filter("length(text) <> n_chars").count() == 0
    before, after = seen["packing"]
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
    assert after.groupBy("sequence_id").sum("length").filter(f"`sum(length)` > {packing.LENGTH}").count() == 0


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, DIR, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
