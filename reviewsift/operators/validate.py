"""Projections, filters and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reviewsift.functions.columns import clip, flags_array, strip, text_or_empty
from reviewsift.schemas import (
    DATASET_COLUMNS, EDA_DROPPED, HUMAN_COLUMNS, LABEL_COLUMNS, LABEL_SOURCES, OUTPUT_FIELDS,
    REVIEW_CONFIDENCE, REVIEW_FLAGS, TASK_COLUMNS,
)
from reviewsift.sources.io import require_columns


class DataCheckError(ValueError):
    """A table breaks one of its declared rules."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("count")).filter(F.col("count") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail when a key repeats; reads at most ten example rows back."""
    examples = duplicate_keys(df, keys).limit(10).collect()
    if examples:
        raise DataCheckError(f"{list(keys)} must be unique, e.g. {[tuple(r)[:-1] for r in examples]}")
    return df


def to_gold(df: DataFrame) -> DataFrame:
    """Remove the human annotation columns that are present."""
    return df.drop(*[c for c in HUMAN_COLUMNS if c in df.columns])


def gold_checks(df: DataFrame, sources: Sequence[str] = LABEL_SOURCES) -> DataFrame:
    """One row of rule violations of a gold table."""
    ids = df.groupBy("annotation_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("is_helpful").isNull()).alias("no_label"),
        F.count_if(~F.coalesce(F.col("label_source").isin(*sources), F.lit(False))).alias("bad"),
    )
    return ids.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"),
        F.coalesce(F.sum("no_label"), F.lit(0)).alias("missing_labels"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("unknown_sources"),
    )


def assert_gold(df: DataFrame, sources: Sequence[str] = LABEL_SOURCES) -> DataFrame:
    """Fail when ids repeat, labels are missing or sources are unknown."""
    left_over = [c for c in HUMAN_COLUMNS if c in df.columns]
    if left_over:
        raise DataCheckError(f"Human columns remain: {left_over}")
    row = gold_checks(df, sources).first()
    broken = {k: v for k, v in row.asDict().items() if k != "rows" and v}
    if broken:
        raise DataCheckError(f"Gold table breaks its rules: {broken}")
    return df


def labeling_task(df: DataFrame) -> DataFrame:
    """Blind labelling task: inputs, labels as `reference_*`, empty `candidate_llm_*`."""
    df = to_gold(df).withColumnsRenamed({c: f"reference_{c}" for c in LABEL_COLUMNS})
    require_columns(df, TASK_COLUMNS)
    return df.select(
        *TASK_COLUMNS,
        *[f"reference_{c}" for c in LABEL_COLUMNS],
        *[F.lit("").alias(f"candidate_llm_{c}") for c in OUTPUT_FIELDS],
    )


def raw_labeling_task(df: DataFrame, check: bool = True) -> DataFrame:
    """Raw inputs with empty `llm_*` columns; ids must be unique."""
    require_columns(df, TASK_COLUMNS)
    if check:
        assert_unique(df, ["annotation_id"])
    return df.select(*TASK_COLUMNS, *[F.lit("").alias(f"llm_{c}") for c in OUTPUT_FIELDS])


def review_dataset(df: DataFrame) -> DataFrame:
    """The slim modelling table; absent optional columns are blank, bad labels fail."""
    require_columns(df, ["review_id", "product_id", "rating", "review_text", "is_helpful"])
    columns = {c: F.col(c) if c in df.columns else F.lit("") for c in DATASET_COLUMNS}
    columns["help"] = F.col("is_helpful").cast("int")
    return df.select(*[columns[c].alias(c) for c in DATASET_COLUMNS])


def first_rows(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row per key in the given order, as an aggregate with partial results."""
    values = [c for c in df.columns if c != key]
    place = F.struct(*[F.col(c) for c in order])
    return (
        df.groupBy(key)
        .agg(F.min_by(F.struct(*values), place).alias("_first"))
        .select(key, "_first.*")
        .select(*df.columns)
    )


def valid_unique(
    df: DataFrame,
    order: Sequence[str],
    text: str = "review_text",
    key: str = "annotation_id",
) -> DataFrame:
    """P5: drop blank texts, then keep the first row per annotation id."""
    return first_rows(df.filter(F.length(F.col(text)) > 0), key, order)


def coerce_types(df: DataFrame) -> DataFrame:
    """Numbers and dates coerced where possible, label cast strictly.

    Only columns that are present are touched.
    """
    rules: dict[str, Column] = {
        "rating": F.col("rating").try_cast("double"),
        "helpful_count": F.coalesce(F.col("helpful_count").try_cast("double"), F.lit(0.0)),
        "helpfulness_score": F.coalesce(
            F.col("helpfulness_score").try_cast("double"), F.lit(0.0)
        ),
        "confidence": clip(
            F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5)), 0.0, 1.0
        ),
        "is_helpful": F.col("is_helpful").cast("int"),
        "help": F.col("help").cast("int"),
        "purchased": F.coalesce(F.col("purchased").try_cast("boolean"), F.lit(False)),
    }
    present = {c: rule for c, rule in rules.items() if c in df.columns}
    for c in ("created_at", "crawled_at"):
        if c in df.columns and dict(df.dtypes)[c] == "string":
            present[c] = F.try_to_timestamp(F.col(c))
    return df.withColumns(present)


def needs_review(confidence: Column, flags: Column) -> Column:
    """Low confidence or a flag that asks for a human."""
    return (confidence < REVIEW_CONFIDENCE) | F.arrays_overlap(
        flags, F.array(*[F.lit(f) for f in REVIEW_FLAGS])
    )


def review_queue(gold: DataFrame) -> DataFrame:
    """Labelled rows a human should look at."""
    if "needs_human_review" in gold.columns:
        wanted = F.col("needs_human_review")
    else:
        wanted = needs_review(F.col("confidence"), F.col("quality_flags"))
    return gold.filter(F.col("is_helpful").isNotNull() & wanted)


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether each column holds one value only; NULL counts as a value."""
    checks = [
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(
                (
                    F.min(c).eqNullSafe(F.max(c))
                    & ((F.count(c) == F.count("*")) | (F.count(c) == 0))
                ),
                F.lit(True),
            ).alias("is_constant"),
        )
        for c in columns
    ]
    return df.agg(F.explode(F.array(*checks)).alias("_c")).select("_c.*")


def drop_constant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the constant ones of the given columns (one pass, one small result row)."""
    rows = constant_columns(df, columns).filter("is_constant").collect()
    return df.drop(*[r["column"] for r in rows])


# Limits of a review request.
MAX_TEXT, MAX_NAME, MAX_CATEGORY, MAX_BRAND = 10_000, 200, 100, 100


def with_errors(df: DataFrame) -> DataFrame:
    """P10: add `errors array<string>` for a table of review requests."""

    def bad_length(name: str, low: int, high: int) -> Column:
        size = F.length(name)
        return F.coalesce(~size.between(low, high), F.lit(True))

    rules = [
        ("product_name", bad_length("product_name", 1, MAX_NAME)),
        ("category", bad_length("category", 1, MAX_CATEGORY)),
        ("rating", F.coalesce(~F.col("rating").between(1, 5), F.lit(True))),
        ("review_text", bad_length("review_text", 1, MAX_TEXT)),
        ("blank_text", (F.length("review_text") > 0) & (strip(text_or_empty("review_text")) == "")),
    ]
    if "price" in df.columns:
        rules.append(("price", F.col("price") < 0))
    if "brand" in df.columns:
        rules.append(("brand", F.length("brand") > MAX_BRAND))
    return df.withColumn("errors", flags_array(*rules))


def validate_reviews(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P10: (valid rows, quarantined rows with their errors)."""
    checked = with_errors(df)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(
        F.size("errors") > 0
    )


def eda_view(df: DataFrame) -> DataFrame:
    """The exploration copy without bookkeeping columns."""
    require_columns(df, EDA_DROPPED)
    return df.drop(*EDA_DROPPED)
