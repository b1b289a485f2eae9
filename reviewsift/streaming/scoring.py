"""Incremental scoring of a stream of reviews (ST1)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from reviewsift.functions.features import reason_codes
from reviewsift.functions.text import with_review_text
from reviewsift.lexicon import Lexicon, VIETNAMESE
from reviewsift.operators.explain import decide, quality_assessment
from reviewsift.operators.rubric import rubric_score

#: Texts average some KB, so a file of so many rows is one small task.
ROWS_PER_FILE = 10_000


def score_rows(
    df: DataFrame,
    lexicon: Lexicon = VIETNAMESE,
    model: Callable[[DataFrame], DataFrame] | None = None,
    normalize: bool = True,
) -> DataFrame:
    """ST1: review text, reason codes, rubric label and information quality of each row.

    Stateless, so it serves batch and streaming frames alike. ``model`` may add
    `probability_helpful`, which is then turned into a decision.
    """
    rows = reason_codes(with_review_text(df), "review_text", lexicon)
    kept = ["review_id", "product_id", "review_text", "model_reason_codes"]
    if model is not None:
        rows = decide(model(rows)).withColumnRenamed("helpfulness_score", "model_score")
        kept += ["label", "model_score", "confidence_level"]
    scored = rubric_score(rows, lexicon, normalize=normalize, keep=tuple(kept))
    return quality_assessment(scored)


def batch_files(rows: DataFrame, batches: int) -> int:
    """How many files each of ``batches`` batches of a table needs for ``ROWS_PER_FILE`` rows a file."""
    return max(1, math.ceil(rows.count() / (ROWS_PER_FILE * batches)))


def read_review_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100
) -> DataFrame:
    """A file stream of reviews."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def score_stream(
    stream: DataFrame, output: str, checkpoint: str, lexicon: Lexicon = VIETNAMESE, **options
) -> StreamingQuery:
    """Score everything that has arrived and append it; run again to resume."""
    return (
        score_rows(stream, lexicon, **options)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )
