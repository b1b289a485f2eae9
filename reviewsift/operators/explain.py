"""Decisions, information quality and explanations."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from reviewsift.functions.columns import clip, col, round_even
from reviewsift.messages import EXPLAIN_INSTRUCTIONS, EXPLANATION
from reviewsift.schemas import LABEL_NAMES

# ---------------------------------------------------------------------------
# Confidence distances, criterion weights and their two levels by reason code.
# ---------------------------------------------------------------------------
HIGH_DISTANCE, MEDIUM_DISTANCE = 0.35, 0.2
QUALITY_WEIGHTS = {
    "specificity": 0.20,
    "feature_coverage": 0.20,
    "balance": 0.15,
    "usage_context": 0.15,
    "verifiability": 0.15,
    "buyer_relevance": 0.15,
}
CRITERION_LEVELS = {
    "specificity": ("specific_experience", 72, 25),
    "feature_coverage": ("mentions_product_features", 72, 30),
    "balance": ("mentions_pros_and_cons", 78, 30),
    "usage_context": ("specific_experience", 65, 25),
    "verifiability": ("specific_experience", 68, 25),
    "buyer_relevance": ("mentions_product_features", 68, 30),
}
DETAIL_BONUS, GENERIC_CAP = 10, 20
LIST_FIELDS = ("why", "evidence_analysis", "strengths", "limitations", "missing_information")
TEXT_FIELDS = (
    "short_assessment", "improvement_suggestion", "suggested_rewrite", "buyer_value",
    "model_alignment",
)


def confidence_level(score: Column | str) -> Column:
    distance = F.abs(col(score) - F.lit(0.5))
    return (
        F.when(distance >= HIGH_DISTANCE, "High")
        .when(distance >= MEDIUM_DISTANCE, "Medium")
        .otherwise("Low")
    )


def decide(df: DataFrame, score: str = "probability_helpful", threshold: float = 0.5) -> DataFrame:
    """Label and confidence level from the unrounded score, and the rounded score."""
    value = clip(F.col(score).cast("double"), 0.0, 1.0)
    return df.withColumns(
        {
            "label": F.when(value >= threshold, LABEL_NAMES[1]).otherwise(LABEL_NAMES[0]),
            "helpfulness_score": round_even(value, 4),
            "confidence_level": confidence_level(value),
        }
    )


def criterion_score(name: str, codes: Column) -> Column:
    code, found, absent = CRITERION_LEVELS[name]
    base = F.when(F.array_contains(codes, code), found).otherwise(absent)
    detailed = F.array_contains(codes, "sufficient_detail")
    base = F.when(detailed, F.least(F.lit(100), base + DETAIL_BONUS)).otherwise(base)
    generic = F.array_contains(codes, "too_generic")
    return F.when(generic, F.least(F.lit(GENERIC_CAP), base)).otherwise(base).cast("double")


def clamp_score(c: Column) -> Column:
    """0..100 with one decimal; anything that is not a number counts as 0."""
    return round_even(F.coalesce(clip(c, 0.0, 100.0), F.lit(0.0)), 1)


def weighted_quality(scores: Mapping[str, Column]) -> Column:
    parts = [scores[name] * weight for name, weight in QUALITY_WEIGHTS.items()]
    return round_even(reduce(lambda a, b: a + b, parts), 1)


def _assessment(
    scores: Mapping[str, Column],
    details: Mapping[str, tuple[Column, Column]],
    messages: Mapping,
    source: str,
) -> Column:
    dimensions = F.array(
        *[
            F.struct(
                F.lit(name).alias("key"),
                F.lit(messages["criteria"][name]).alias("criterion"),
                scores[name].alias("score"),
                F.lit(weight).alias("weight"),
                details[name][0].alias("evidence"),
                details[name][1].alias("explanation"),
            )
            for name, weight in QUALITY_WEIGHTS.items()
        ]
    )
    return F.struct(
        weighted_quality(scores).alias("information_quality_score"),
        F.lit("supplemental_rubric_score").alias("score_type"),
        F.lit(source).alias("source"),
        dimensions.alias("dimensions"),
        F.lit(messages["disclaimer"]).alias("disclaimer"),
    )


def _local_assessment(codes: Column, messages: Mapping) -> Column:
    scores = {n: clamp_score(criterion_score(n, codes)) for n in QUALITY_WEIGHTS}
    note = (F.lit(""), F.lit(messages["rubric_note"]))
    return _assessment(scores, {n: note for n in QUALITY_WEIGHTS}, messages, "local_rubric")


def quality_assessment(
    df: DataFrame, codes: str = "model_reason_codes", messages: Mapping = EXPLANATION
) -> DataFrame:
    """Information-quality score with its six dimensions, from the reason codes."""
    return df.withColumn("quality_assessment", _local_assessment(F.col(codes), messages))


def quality_from_scores(
    df: DataFrame, scores: Mapping[str, str], output: str = "information_quality_score"
) -> DataFrame:
    """R9 on given criterion scores (column names by criterion), clamped and weighted."""
    clamped = {n: clamp_score(F.col(c).try_cast("double")) for n, c in scores.items()}
    return df.withColumn(output, weighted_quality(clamped))


def explain_local(
    df: DataFrame, codes: str = "model_reason_codes", messages: Mapping = EXPLANATION
) -> DataFrame:
    """The explanation struct built from label, score and reason codes."""
    pairs = [F.lit(x) for pair in messages["reason"].items() for x in pair]
    texts = F.create_map(*pairs)
    known = F.filter(F.col(codes), lambda c: F.map_contains_key(texts, c))
    reasons = F.transform(known, lambda c: F.element_at(texts, c))
    why = F.when(F.size(reasons) == 0, F.array(F.lit(messages["no_reason"]))).otherwise(
        F.slice(reasons, 1, 3)
    )
    helpful = F.col("label") == LABEL_NAMES[1]

    def choose(name: str) -> Column:
        return F.when(helpful, messages[f"{name}_helpful"]).otherwise(messages[f"{name}_unhelpful"])

    def texts_array(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    # The first three codes are looked up, then unknown ones are left out.
    first = F.filter(F.slice(codes, 1, 3), lambda c: F.map_contains_key(texts, c))
    evidence = F.transform(
        first,
        lambda c: F.struct(
            c.alias("criterion"),
            F.lit("detected").alias("status"),
            F.lit(messages["evidence"]).alias("evidence"),
            F.element_at(texts, c).alias("analysis"),
            F.lit(messages["buyer_impact"]).alias("buyer_impact"),
        ),
    )
    explanation = F.struct(
        choose("assessment").alias("short_assessment"),
        F.struct(
            F.col("label"),
            F.col("helpfulness_score"),
            F.col("confidence_level"),
            choose("score").alias("explanation"),
        ).alias("score_interpretation"),
        F.col("_why").alias("why"),
        evidence.alias("evidence_analysis"),
        F.when(helpful, F.col("_why")).otherwise(texts_array([])).alias("strengths"),
        F.when(helpful, texts_array([])).otherwise(texts_array(messages["limitations"]))
        .alias("limitations"),
        F.when(helpful, texts_array(messages["missing_helpful"]))
        .otherwise(texts_array(messages["missing_unhelpful"]))
        .alias("missing_information"),
        choose("suggestion").alias("improvement_suggestion"),
        F.lit(messages["rewrite"]).alias("suggested_rewrite"),
        choose("buyer_value").alias("buyer_value"),
        F.lit(messages["alignment"]).alias("model_alignment"),
        _local_assessment(F.col(codes), messages).alias("quality_assessment"),
        F.lit("local_fallback").alias("source"),
    )
    return df.withColumn("_why", why).withColumn("explanation", explanation).drop("_why")


def merge_explanations(
    df: DataFrame,
    remote: str = "remote_json",
    local: str = "explanation",
    messages: Mapping = EXPLANATION,
    failed_source: str = "local_fallback_after_remote_error",
    output: str = "explanation",
) -> DataFrame:
    """Remote explanation fields over the local ones.

    The model's label, score and level always win; lists that are not lists fall back; the
    quality scores are recomputed from the remote criterion scores. Rows without a usable
    remote object keep the local explanation.
    """
    df = df.withColumn("_r", F.try_parse_json(F.col(remote)))
    r = F.col("_r")
    usable = F.try_variant_get(r, "$", "map<string,variant>").isNotNull()

    def remote_text(path: str, fallback: Column) -> Column:
        return F.coalesce(F.try_variant_get(r, path, "string"), fallback)

    def remote_list(name: str) -> Column:
        fallback = F.col(f"{local}.{name}")
        dtype = "array<string>"
        if name == "evidence_analysis":
            dtype = (
                "array<struct<criterion:string,status:string,evidence:string,"
                "analysis:string,buyer_impact:string>>"
            )
        return F.coalesce(F.try_variant_get(r, f"$.{name}", dtype), fallback)

    scores = {
        n: clamp_score(F.try_variant_get(r, f"$.rubric_scores.{n}", "double"))
        for n in QUALITY_WEIGHTS
    }
    details = {
        n: (
            remote_text(f"$.rubric_details.{n}.evidence", F.lit("")),
            remote_text(f"$.rubric_details.{n}.explanation", F.lit("")),
        )
        for n in QUALITY_WEIGHTS
    }
    base = f"{local}.score_interpretation"
    interpretation = F.struct(
        F.col(f"{base}.label").alias("label"),
        F.col(f"{base}.helpfulness_score").alias("helpfulness_score"),
        F.col(f"{base}.confidence_level").alias("confidence_level"),
        remote_text("$.score_interpretation.explanation", F.col(f"{base}.explanation")).alias(
            "explanation"
        ),
    )
    merged = {n: remote_text(f"$.{n}", F.col(f"{local}.{n}")) for n in TEXT_FIELDS}
    merged |= {n: remote_list(n) for n in LIST_FIELDS}
    merged["score_interpretation"] = interpretation
    merged["quality_assessment"] = _assessment(scores, details, messages, "remote_rubric")
    merged["source"] = F.lit("remote")
    names = [f.name for f in df.schema[local].dataType.fields]
    remote_version = F.struct(*[merged[n].alias(n) for n in names])
    kept = F.struct(
        *[
            F.when(F.col(remote).isNotNull(), F.lit(failed_source))
            .otherwise(F.col(f"{local}.source")).alias(n)
            if n == "source"
            else F.col(f"{local}.{n}").alias(n)
            for n in names
        ]
    )
    return df.withColumn(output, F.when(usable, remote_version).otherwise(kept)).drop("_r")


def response_status(
    df: DataFrame,
    http_status: str = "http_status",
    error_kind: str = "error_kind",
    finish_reason: str = "finish_reason",
    body: str = "response_text",
    prefix: str = "remote",
    output: str = "fallback_reason",
) -> DataFrame:
    """Why a remote answer could not be used; NULL when it could.

    ``error_kind`` is the transport problem, if any: `http`, `timeout` or `connection`.
    """
    parsed = F.try_parse_json(F.col(body))
    status = F.col(http_status)
    kind = F.col(error_kind)
    finish = F.col(finish_reason)
    rule = (
        F.when(status >= 400, F.concat(F.lit(f"{prefix}_http_"), status.cast("string")))
        .when(kind == "http", f"{prefix}_http_error")
        .when(kind == "timeout", f"{prefix}_timeout")
        .when(kind.isNotNull(), f"{prefix}_connection_error")
        .when(
            (F.length(finish) > 0) & (finish != "STOP"),
            F.lower(F.concat(F.lit(f"{prefix}_"), finish)),
        )
        .when(F.col(body).isNull(), f"{prefix}_response_error")
        .when(parsed.isNull(), f"{prefix}_invalid_json")
        .when(
            F.try_variant_get(parsed, "$", "map<string,variant>").isNull(),
            f"{prefix}_response_error",
        )
    )
    return df.withColumn(output, rule)


def explain_requests(
    df: DataFrame,
    product_fields: tuple[str, ...] = (
        "product_name", "category", "rating", "price", "brand", "verified_purchase",
    ),
    model_fields: tuple[str, ...] = (
        "label", "helpfulness_score", "confidence_level", "model_reason_codes",
    ),
    template: str = EXPLAIN_INSTRUCTIONS,
) -> DataFrame:
    """Explanation request with product, review and model result as JSON, and the prompt."""
    present = [c for c in product_fields if c in df.columns]
    product = F.to_json(F.struct(*present), {"ignoreNullFields": "false"})
    model = F.to_json(F.struct(*model_fields))
    review = F.to_json(F.struct("review_text"))
    weights = F.lit(", ".join(f"{n}={w:.2f}" for n, w in QUALITY_WEIGHTS.items()))
    return df.withColumns(
        {"product_json": product, "model_json": model, "review_json": review}
    ).withColumn(
        "prompt",
        F.concat_ws("\n", F.lit(template), "product_json", "review_json", "model_json", weights),
    )


