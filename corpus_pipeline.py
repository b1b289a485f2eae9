"""The training-data pipeline: each stage works on all rows its predecessor kept.

A stage is (name, function of (spark, docs, sf_dir)). All but the last return the columns of
``documents``; the driver writes each result as Parquet and hands it to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsift.llm import byte_bpe, common, decontaminate, exact_dedup, ngram_join, toxicity
from reviewsift.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the model learns from the folder's labels."""
    model = toxicity.learn(common.narrow(docs, "doc_id", "text"), common.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    kept = exact_dedup.deduplicate(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("kept_id")), "left_semi")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies its smallest id stays; rows without an id stay."""
    found = ngram_join.components_by_shingles(docs)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("gone_id"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    # Fewer states than alone: the executors' heaps are full from the stages before.
    return byte_bpe.encode_decode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"), states=50_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode),
]

#: Two stages (a learned score, edit similarity) have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
