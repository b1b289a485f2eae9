"""Table schemas and fixed column lists shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column lists, ranges and value sets of the data model.
# ---------------------------------------------------------------------------
ALLOWED_FLAGS = (
    "generic_only",
    "too_short_but_specific",
    "noise_text",
    "duplicate_like",
    "shipping_only",
    "seller_service_only",
    "irrelevant",
    "possible_fake_or_spam",
    "ambiguous",
    "contains_product_defect",
    "contains_usage_context",
    "contains_comparison",
    "contains_size_fit_info",
    "contains_durability_info",
    "contains_packaging_info",
)
REVIEW_FLAGS = ("ambiguous", "possible_fake_or_spam")
REVIEW_CONFIDENCE = 0.7

RUBRIC_RANGES = {
    "specificity": (0, 2),
    "product_experience": (0, 2),
    "decision_value": (0, 2),
    "clarity": (0, 1),
    "noise_penalty": (-2, 0),
}
RUBRIC_COLUMNS = tuple(RUBRIC_RANGES)

HUMAN_COLUMNS = (
    "annotator_id",
    "manual_label",
    "label_confidence",
    "label_notes",
    "original_manual_label",
    "agrees_with_original",
)
LABEL_SOURCES = ("llm", "codex_rule_adjudicated")

TASK_COLUMNS = (
    "annotation_id",
    "sample_group",
    "review_id",
    "product_id",
    "user_id",
    "rating",
    "purchased_int",
    "word_count",
    "title",
    "content",
    "review_text",
    "source_file",
)
LABEL_COLUMNS = (
    "is_helpful",
    "helpfulness_score",
    "confidence",
    "reason",
    *RUBRIC_COLUMNS,
    "quality_flags",
    "label_version",
    "label_source",
    "adjudicated",
    "needs_human_review",
)
OUTPUT_FIELDS = (
    "is_helpful",
    "helpfulness_score",
    "confidence",
    "reason",
    *RUBRIC_COLUMNS,
    "quality_flags",
    "label_version",
    "model",
)
MERGE_KEYS = ("review_id", "product_id", "user_id")
FULL_COLUMNS = (
    "review_id",
    "product_id",
    "user_id",
    "rating",
    "title",
    "content",
    "review_text",
    "created_at",
    "helpful_count",
    "purchased",
    "purchased_int",
    "crawled_at",
    "word_count",
    "annotation_id",
    "sample_group",
    "help",
    *LABEL_COLUMNS[1:],
)
DATASET_COLUMNS = (
    "review_id",
    "product_id",
    "product_name",
    "category",
    "rating",
    "review_text",
    "helpful_count",
    "created_at",
    "help",
)
EDA_DROPPED = ("adjudicated", "needs_human_review")
METADATA_FEATURES = (
    "rating",
    "word_count",
    "content_len",
    "title_len",
    "text_len",
    "has_title",
    "has_content",
    "exclamation_count",
    "question_count",
    "digit_count",
    "uppercase_ratio",
    "is_low_rating",
    "is_high_rating",
    "is_extreme_rating",
)
LABEL_NAMES = {0: "Not Helpful", 1: "Helpful"}
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

_S, _I, _L, _D, _B, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


RAW_REVIEWS = _struct(
    review_id=_S, product_id=_S, user_id=_S, rating=_I, title=_S, content=_S,
    created_at=_TS, helpful_count=_I, purchased=_B, crawled_at=_TS,
)
ANNOTATION_BATCH = _struct(
    annotation_id=_S, sample_group=_S, review_id=_S, product_id=_S, user_id=_S, rating=_I,
    purchased_int=_I, word_count=_I, title=_S, content=_S, annotator_id=_S, manual_label=_S,
    label_confidence=_S, label_notes=_S,
)
LABELS = _struct(
    annotation_id=_S, is_helpful=_I, helpfulness_score=_I, confidence=_D, reason=_S,
    specificity=_I, product_experience=_I, decision_value=_I, clarity=_I, noise_penalty=_I,
    quality_flags=T.ArrayType(_S), label_version=_S, label_source=_S, adjudicated=_B,
    needs_human_review=_B,
)
CHECKPOINT = T.StructType([*LABELS.fields, T.StructField("batch_seq", _L, True)])
REQUEST = _struct(
    product_name=_S, category=_S, rating=_I, review_text=_S, price=_D, brand=_S,
    verified_purchase=_B,
)
