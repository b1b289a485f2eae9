"""Joins of the gold table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from reviewsift.functions.features import derived_flags
from reviewsift.functions.text import with_review_text
from reviewsift.operators.validate import DataCheckError, assert_unique
from reviewsift.schemas import FULL_COLUMNS, LABEL_COLUMNS, MERGE_KEYS
from reviewsift.sources.io import latest_labels, require_columns


def missing_keys(
    labels: DataFrame, raw: DataFrame, keys: Sequence[str] = MERGE_KEYS, n: int = 10
) -> DataFrame:
    """The first n label keys without a raw review, sorted."""
    return (
        labels.select(*keys)
        .join(raw.select(*keys), list(keys), "left_anti")
        .distinct()
        .orderBy(*keys)
        .limit(n)
    )


def full_labeled(
    raw: DataFrame,
    labels: DataFrame,
    keys: Sequence[str] = MERGE_KEYS,
    check: bool = True,
) -> DataFrame:
    """Raw reviews with their labels and derived columns, sorted by annotation id.

    ``check`` runs the one-to-one and coverage tests first, as separate small jobs.
    """
    require_columns(raw, keys)
    needed = ["annotation_id", "sample_group", *keys, *LABEL_COLUMNS]
    require_columns(labels, needed)
    if check:
        assert_unique(raw, ["review_id"])
        assert_unique(labels, ["review_id"])
        absent = missing_keys(labels, raw, keys).collect()
        if absent:
            raise DataCheckError(f"Labels without a raw review: {[tuple(r) for r in absent]}")
    extra = [c for c in needed if c not in keys and c in raw.columns]
    merged = raw.drop(*extra).join(labels.select(*needed), list(keys), "inner")
    merged = derived_flags(with_review_text(merged))
    merged = merged.withColumn("help", F.col("is_helpful").cast("int"))
    return merged.select(*FULL_COLUMNS).orderBy("annotation_id")


def with_agreement(df: DataFrame) -> DataFrame:
    """Whether the label equals a binary human label; anything else counts as false."""
    original = F.col("manual_label").cast("string")
    same = original.isin("0", "1") & (original == F.col("is_helpful").cast("string"))
    return df.withColumns(
        {"original_manual_label": original, "agrees_with_original": F.coalesce(same, F.lit(False))}
    )


def gold_join(source: DataFrame, labels: DataFrame, check: bool = False) -> DataFrame:
    """The source rows with their labels, if any, and the agreement columns."""
    if check:
        assert_unique(source, ["annotation_id"])
        assert_unique(labels, ["annotation_id"])
    merged = with_agreement(source.join(labels, "annotation_id", "left"))
    return merged.withColumn(
        "quality_flags", F.coalesce("quality_flags", F.array().cast("array<string>"))
    )


def pending(source: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Source rows whose annotation id is not in the checkpoint."""
    return source.join(checkpoint.select("annotation_id"), "annotation_id", "left_anti")


def batch_mismatches(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per requested id without an answer (`missing`) or answer nobody asked for
    (`extra`)."""
    keys = ["batch_id", "annotation_id"]
    asked = requests.select(*keys).distinct().withColumn("asked", F.lit(True))
    given = responses.select(*keys).distinct().withColumn("given", F.lit(True))
    return (
        asked.join(given, keys, "full_outer")
        .filter(F.col("asked").isNull() | F.col("given").isNull())
        .select(*keys, F.when(F.col("given").isNull(), "missing").otherwise("extra").alias("status"))
    )


def batch_audit(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Per batch, requested and answered ids, missing and extra counts, and `complete`."""
    keys = ["batch_id", "annotation_id"]
    asked = requests.select(*keys).distinct().withColumn("asked", F.lit(1))
    given = responses.select(*keys).distinct().withColumn("given", F.lit(1))
    both = asked.join(given, keys, "full_outer")
    count = both.groupBy("batch_id").agg(
        F.count("asked").alias("requested"),
        F.count("given").alias("answered"),
        F.count_if(F.col("given").isNull()).alias("missing"),
        F.count_if(F.col("asked").isNull()).alias("extra"),
    )
    return count.withColumn("complete", (F.col("missing") == 0) & (F.col("extra") == 0))


def complete_labels(
    source: DataFrame, checkpoint: DataFrame, scorer: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Labels of the checkpoint plus scored labels for all other rows."""
    kept = latest_labels(checkpoint) if "batch_seq" in checkpoint.columns else checkpoint
    columns = ["annotation_id", *LABEL_COLUMNS]
    scored = scorer(pending(source, kept))
    return kept.select(*columns).unionByName(scored.select(*columns))


def complete_gold(
    source: DataFrame, checkpoint: DataFrame, scorer: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """J6 then J3: the gold table with every row labelled."""
    return gold_join(source, complete_labels(source, checkpoint, scorer))
