"""The pipeline's stages, one after the other, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from conftest import SF_SMALL
from relaywatch.llm import decontaminate, minhash_dedup, secret_scan
from relaywatch.llm.common import table


def test_stages_take_effect(spark, scratch):
    docs = table(spark, SF_SMALL, "documents")
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF_SMALL, "labels").collect()}
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, before, SF_SMALL).write.parquet(f"{scratch}/{name}")
        after = spark.read.parquet(f"{scratch}/{name}")
        assert after.columns == columns
        gone = {r["doc_id"] for r in before.join(after, "doc_id", "left_anti").collect()}
        if name == "toxicity":
            assert sum(labels.get(i) == 0 for i in gone) <= 3
        if name == "minhash_dedup":
            assert minhash_dedup.near_duplicates(after).filter("not kept").count() == 0 and gone
        if name == "decontaminate":
            assert decontaminate.contaminated(after, table(spark, SF_SMALL, "benchmark")).count() == 0
        if name == "secrets":
            assert not gone and secret_scan.scan(after).filter("n_access + n_hex + n_assign > 0").count() == 0
            assert after.filter("n_chars <> length(text)").count() == 0
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF_SMALL)
    assert last.count() == before.count() and last.filter("n_tokens is null").count() == 0


def test_empty_documents(spark):
    docs = table(spark, SF_SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_SMALL).count() == 0


def test_columns_of_any_name_keep_their_values(spark):
    docs = table(spark, SF_SMALL, "documents").limit(300)
    odd = docs.selectExpr("*", "doc_id * 2 AS score", "doc_id + 1 AS ids", "doc_id + 2 AS decoded", "doc_id + 3 AS row_key")
    kept = corpus_pipeline.without_toxic(spark, odd, SF_SMALL)
    assert kept.columns == odd.columns
    assert kept.filter("score <> doc_id * 2 OR ids <> doc_id + 1 OR row_key <> doc_id + 3").count() == 0 < kept.count()


def test_a_failed_stage_leaves_no_scratch_tables(spark, scratch, monkeypatch):
    def fails(spark, docs, sf_dir):
        return docs.selectExpr("raise_error('stop') AS doc_id")

    made = []

    class Watched(corpus_pipeline.Scratch):
        def __init__(self, spark):
            super().__init__(spark)
            made.append(self.root)

    monkeypatch.setattr(corpus_pipeline, "Scratch", Watched)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", lambda s, d, _: d), ("fails", fails), ("last", None)])
    with pytest.raises(Exception, match="stop"):
        corpus_pipeline.run(spark, SF_SMALL)
    assert made and not any(os.path.exists(m.removeprefix("file:")) for m in made)
