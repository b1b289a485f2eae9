"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import collections

import pytest

pytest.importorskip("reviewsift.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, small):
    from test_operators import brute_components, brute_groups, encodings
    from reviewsift.llm import toxicity

    documents = spark.read.parquet(f"{small}/documents.parquet")
    toxic = {r["doc_id"] for r in toxicity.query(spark, small).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in documents.collect() if r["doc_id"] not in toxic]
    kept = []
    for members in brute_groups(rows).values():
        longest = max(len(t) for _, t in members)
        kept.append(min((i, t) for i, t in members if len(t) == longest))
    roots = brute_components(kept)
    kept = [(i, t) for i, t in kept if roots[i][1] == i]
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    left = {i: t for i, t in kept if not any(item in " ".join(t.lower().split()) for item in items)}
    library, _ = encodings()
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, small).collect()}
    assert got == {i: len(library.encode_ordinary(t)) for i, t in left.items()}


def test_stages_survive_edge_rows(spark, tmp_path):
    from test_operators import ITEM, SCHEMA, edge_rows

    spark.createDataFrame(edge_rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0), (7, 1)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns, name
        rows = collections.Counter(r["doc_id"] for r in made.collect())
        assert set(rows) <= {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
