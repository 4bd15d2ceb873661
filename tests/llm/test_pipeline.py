"""The pipeline's stages, each on what its predecessor kept, and the queries' registration."""

import corpus_pipeline
from gridloom.llm import queries


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns
        after = after.cache()
        gone = {r.doc_id for r in before.select("doc_id").collect()} - {r.doc_id for r in after.select("doc_id").collect()}
        if name == "language_id":
            assert not gone
        before = after
    ids = [r.doc_id for r in before.collect()]
    assert len(ids) == len(set(ids)) and len(ids) > 50
    texts = [r.text for r in before.collect()]
    assert len(texts) == len(set(texts))
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir).collect()
    assert {r.doc_id for r in last} == set(ids) and all(r.round_trip for r in last)


def test_run_is_the_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).where("round_trip").count() > 50
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "encode"]


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
