"""The pipeline: each stage's decisions on what the one before kept."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir, tmp_path):
    from parley.llm.tokenids import read_corpus  # noqa: F401
    from tests.llm import brute

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame([(90_001, None, "en", "src0", 0), (90_002, "123 456", "en", "src0", 7)], docs.schema)
    docs = docs.unionByName(extra)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
    assert all(kept[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])
    ids = lambda n: [r["doc_id"] for r in kept[n].select("doc_id").collect()]
    assert {90_001, 90_002}.isdisjoint(ids("language_id")) and len(ids("language_id")) == 200
    rows = [(r["doc_id"], r["text"]) for r in kept["language_id"].collect()]
    assert sorted(ids("near_dedup")) == sorted(i for i, _, _, k in brute.near_duplicates(rows, 5, 80) if k)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in kept["near_dedup"].collect()]
    assert sorted(ids("decontamination")) == sorted(x[0] for x in brute.contamination(rows, bench, 10) if not x[5])
    assert set(ids("source_mix")) <= set(ids("decontamination"))
    assert max(r["n"] for r in kept["source_mix"].groupBy("doc_id").agg(F.count("*").alias("n")).collect()) <= 3
    assert sorted(ids("token_ids")) == sorted(ids("source_mix"))
