"""End-to-end flows composed from the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from reviewsift.functions.features import eda_features
from reviewsift.functions.text import nfc_corpus, with_review_text
from reviewsift.lexicon import Lexicon, VIETNAMESE
from reviewsift.operators import reports
from reviewsift.operators.gold import gold_join, pending
from reviewsift.operators.ranking import rank_reviews, work_slice
from reviewsift.operators.responses import (
    batch_status, explode_responses, label_requests, normalize_labels, parsed_labels,
    retry_requests,
)
from reviewsift.operators.rubric import refine_flags
from reviewsift.operators.validate import assert_unique, review_queue, validate_reviews
from reviewsift.session import materialize
from reviewsift.sources.io import append_checkpoint, read_checkpoint


def next_requests(
    source: DataFrame,
    checkpoint: DataFrame | None,
    batch_size: int = 20,
    start: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Requests for the rows of a work slice that are not labelled yet.

    Ids must be unique, and texts are cleaned (NFC, white space) before they reach a prompt.
    """
    assert_unique(source, ["annotation_id"])
    source = nfc_corpus(source, ["title", "content"])
    rows = work_slice(source, start, limit, [F.col("annotation_id")])
    if checkpoint is not None:
        rows = pending(rows, checkpoint)
    return label_requests(rows, batch_size, [F.col("annotation_id")])


def accept_responses(
    requests: DataFrame,
    responses: DataFrame,
    source: DataFrame,
    directory: str,
    batch_seq: int,
    lexicon: Lexicon = VIETNAMESE,
) -> dict[str, DataFrame]:
    """Normalise, audit and refine answers, append the labels of whole batches to the
    checkpoint, and plan the retries.

    ``requests`` has one row per requested id (`batch_id`, `annotation_id`).
    """
    items = explode_responses(responses)
    parsed = parsed_labels(items)
    status = batch_status(requests, parsed)
    labels, rejects = normalize_labels(items)
    accepted = labels.join(status.filter("batch_ok").select("batch_id"), "batch_id", "left_semi")
    texts = with_review_text(nfc_corpus(source, ["title", "content"]), output="_text")
    refined = refine_flags(
        accepted.join(texts.select("annotation_id", "_text"), "annotation_id"), "_text", lexicon
    ).drop("_text")
    append_checkpoint(refined, directory, batch_seq)
    return {
        "rejects": rejects,
        "status": status,
        "retries": retry_requests(requests, status),
    }


def gold_outputs(source: DataFrame, directory: str) -> dict[str, DataFrame]:
    """Gold table, review queue and labelling report from a checkpoint."""
    gold = gold_join(source, read_checkpoint(source.sparkSession, directory))
    return {
        "gold": gold,
        "review_queue": review_queue(gold),
        "report": reports.labeling_report(gold),
    }


def gold_reports(gold: DataFrame, label: str = "is_helpful") -> dict[str, DataFrame]:
    """The standard reports over one gold table, each an independent plan.

    The columns they need are written once, without the texts.
    """
    texts = ("title", "content", "review_text", "reason")
    narrow = materialize(
        gold.select(
            *[c for c in gold.columns if c not in texts],
            # Only whether a text is missing is reported.
            F.when(F.col("content").isNotNull(), "").alias("content"),
        )
    )
    named: Mapping[str, Callable[[DataFrame, str], DataFrame]] = {
        "label_distribution": reports.label_distribution,
        "rating_analysis": reports.by_rating,
        "length_analysis": reports.by_length,
        "sample_group_analysis": reports.by_sample_group,
        "score_distribution": reports.by_score,
        "confidence_analysis": reports.by_confidence,
        "source_analysis": reports.by_source,
        "purchase_analysis": reports.by_purchase,
        "rubric_by_label": reports.rubric_by_label,
        "quality_flags_analysis": reports.flag_summary,
        "label_profile": reports.label_profile,
    }
    result = {name: report(narrow, label) for name, report in named.items()}
    result["correlation_matrix"] = reports.correlation_matrix(narrow)
    result["summary"] = reports.summary(narrow, label).withColumn(
        "columns", F.lit(len(gold.columns))
    )
    return result


def exploration_reports(full: DataFrame) -> dict[str, DataFrame]:
    """The exploration reports over a fully labelled table, whose features are written once."""
    rows = materialize(eda_features(full).drop("title", "content"))
    return {
        "overview": reports.overview(rows),
        "quality": reports.quality_counters(rows),
        "length_summary": reports.length_by_label(rows),
        "length_effect": reports.by_length(rows, length="review_word_length", fine=True),
        "vote_summary": reports.by_votes(rows),
        "vote_effect": reports.by_votes(rows, buckets=True),
        "year_summary": reports.by_year(rows),
        "weekday_summary": reports.by_weekday(rows),
        "word_frequencies": reports.word_frequencies(rows),
    }


def score_and_rank(
    requests: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    partition_by: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(ranked reviews, quarantined requests) for a table of review requests.

    ``score`` adds `helpfulness_score`; ``requests`` carries `original_index`. The scored rows
    are written once, because a range partitioning reads its input twice (to find the ranges).
    """
    valid, bad = validate_reviews(requests)
    return rank_reviews(materialize(score(valid)), partition_by), bad
