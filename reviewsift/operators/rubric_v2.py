"""Second rule rubric, built from regex families."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from reviewsift.functions.columns import (
    bool_int, clip, flags_array, mapped, matches, round_even, strip, word_count,
)
from reviewsift.functions.terms import occurrences, occurs, pattern_terms, with_found_terms
from reviewsift.lexicon import (
    PatternSet, V2_EMPTY_FLAGS, V2_INFORMATIVE_FLAGS, V2_ONLY_PUNCTUATION, VIETNAMESE_PATTERNS,
)
from reviewsift.messages import RUBRIC_V2_REASONS
from reviewsift.schemas import RUBRIC_COLUMNS

# ---------------------------------------------------------------------------
# Thresholds and names of the second rubric.
# ---------------------------------------------------------------------------
LABEL_VERSION = "llm_helpfulness_v2"
HELPFUL_FROM, UNHELPFUL_TO = 3, 1
REPEAT_UNCLEAR = r"(.)\1{5,}"
REPEAT_NOISE = r"(.)\1{6,}"


def _levels(two: Column, one: Column) -> Column:
    return F.when(two, 2).when(one, 1).otherwise(0)


@F.arrow_udf(T.BooleanType())
def duplicate_like(texts: pa.Array) -> pa.Array:
    """More than 12 words, and over a third of them occur in both halves of the text.

    Counting copies against a set is linear in the words; array functions compare the halves
    word by word.
    """

    def check(text: str) -> bool:
        words = text.split()
        half = len(words) // 2
        later = set(words[half:])
        return len(words) > 12 and sum(w in later for w in words[:half]) > len(words) // 3

    return mapped(texts, check, pa.bool_())


def _flags(patterns: dict[str, str]) -> Column:
    low, sp = F.col("_low"), F.col("specificity")

    def matched(pattern: str) -> Column:
        return occurs(low, F.col("_found"), pattern)

    shipping_only = (sp == 0) & matched(patterns["shipping"]) & ~matched(patterns["product"])
    seller_only = (
        (sp == 0)
        & matched(patterns["seller"])
        & ~matched(patterns["product"])
        & ~shipping_only
    )
    nothing = sp + F.col("product_experience") + F.col("decision_value") == 0
    named = {
        name: matched(pattern)
        for name, pattern in patterns.items()
        if name not in ("shipping", "product", "seller")
    }
    named["contains_usage_context"] = named["contains_usage_context"] & (sp >= 1)
    return F.array_sort(
        flags_array(
            ("generic_only", nothing),
            ("too_short_but_specific", (F.col("_wc") <= 5) & (sp >= 1)),
            ("noise_text", F.col("noise_penalty") <= -1),
            ("shipping_only", shipping_only),
            ("seller_service_only", seller_only),
            *named.items(),
            ("duplicate_like", F.col("_duplicate")),
            ("ambiguous", F.col("helpfulness_score").between(2, 3)),
        )
    )


def _reason(messages: Mapping[str, str]) -> Column:
    def has(flag: str) -> Column:
        return F.array_contains("quality_flags", flag)

    listed = F.array_compact(
        F.array(
            *[
                F.when(has(flag), messages[flag])
                for flag in (*V2_INFORMATIVE_FLAGS, "too_short_but_specific")
            ],
            F.when(F.col("product_experience") >= 2, messages["experience"]),
            F.when(F.col("specificity") >= 2, messages["specific"]),
        )
    )
    unhelpful = (
        F.when(has("shipping_only") & has("generic_only"), messages["shipping_generic"])
        .when(has("shipping_only"), messages["shipping"])
        .when(has("seller_service_only"), messages["seller"])
        .when(has("generic_only"), messages["generic"])
        .otherwise(messages["unhelpful"])
    )
    return (
        F.when(F.col("noise_penalty") <= -2, messages["noise_only"])
        .when(has("noise_text"), messages["noise_repeat"])
        .when(F.col("is_helpful") == 0, unhelpful)
        .when(F.size(listed) == 0, messages["helpful"])
        .otherwise(
            F.concat_ws(
                " ", F.lit(messages["prefix"]), F.array_join(listed, ", "), F.lit(messages["suffix"])
            )
        )
    )


def rubric_score_v2(
    df: DataFrame,
    patterns: PatternSet = VIETNAMESE_PATTERNS,
    messages: Mapping[str, str] = RUBRIC_V2_REASONS,
    prefix: str = "candidate_llm_",
    model: str = "rule_rubric_v2",
    keep: tuple[str, ...] = ("annotation_id",),
) -> DataFrame:
    """The second rubric on `review_text`, or on `content` where that is empty.

    A stored `word_count` is used when present.
    """
    empty = F.lit("")
    candidates = [F.col(c) for c in ("review_text", "content") if c in df.columns]
    text = F.coalesce(*[F.when(F.length(c) > 0, c) for c in candidates], empty)
    df = df.withColumn("_text", text)
    words = word_count("_text")
    stored = F.coalesce(F.col("word_count").cast("int"), words) if "word_count" in df.columns else words
    df = df.withColumns({"_low": F.lower("_text"), "_words": words, "_wc": stored})
    # Python steps first; see rubric_score.
    df = df.withColumn("_duplicate", duplicate_like(F.col("_low")))
    df = with_found_terms(df, "_low", pattern_terms(patterns.every()), "_found")
    low, found = F.col("_low"), F.col("_found")
    df = df.withColumns(
        {
            "_strong": occurrences(low, found, patterns.specific_strong),
            "_medium": occurrences(low, found, patterns.specific_medium),
            "_used": occurrences(low, found, patterns.experience),
            "_dec_strong": occurrences(low, found, patterns.decision_strong),
            "_dec_medium": occurrences(low, found, patterns.decision_medium),
        }
    )
    strong, medium, used = F.col("_strong"), F.col("_medium"), F.col("_used")
    df = df.withColumns(
        {
            "specificity": _levels(
                (strong >= 2) | ((strong >= 1) & (medium >= 1)), strong + medium >= 1
            ),
            "product_experience": F.when(occurs(low, found, patterns.not_used_yet), 0).otherwise(
                F.least(used, F.lit(2))
            ),
        }
    )
    sp, pe = F.col("specificity"), F.col("product_experience")
    dec_strong, dec_medium = F.col("_dec_strong"), F.col("_dec_medium")
    # Seven equal characters in a row are six, too: the second search is for the few texts with six.
    df = df.withColumn("_repeats", F.col("_text").rlike("(?d)" + REPEAT_UNCLEAR))
    unclear = (F.col("_words") <= 2) | F.col("_repeats") | ~F.col("_text").rlike(r"[\p{L}\p{N}_]")
    noise = F.when(matches(strip(low), V2_ONLY_PUNCTUATION), -2).when(
        F.col("_repeats") & F.col("_text").rlike("(?d)" + REPEAT_NOISE), -1
    ).otherwise(0)
    spam = F.lit(False)
    for pattern in patterns.spam:
        spam = spam | occurs(low, found, pattern)
    df = df.withColumns(
        {
            "decision_value": _levels(
                (dec_strong >= 2) | ((dec_strong >= 1) & (sp >= 2)),
                (dec_strong >= 1) | (dec_medium >= 2) | ((sp >= 1) & (pe >= 1)),
            ),
            "clarity": F.when(unclear, 0).otherwise(1),
            "noise_penalty": F.greatest(noise - bool_int(spam), F.lit(-2)),
        }
    )
    df = df.withColumn("helpfulness_score", sum((F.col(c) for c in RUBRIC_COLUMNS), F.lit(0)))
    df = df.withColumn("quality_flags", _flags(dict(patterns.flags)))

    score, flags = F.col("helpfulness_score"), F.col("quality_flags")

    def any_of(names: tuple[str, ...]) -> Column:
        return F.arrays_overlap(flags, F.array(*[F.lit(n) for n in names]))

    label = (
        F.when(score >= HELPFUL_FROM, 1)
        .when(score <= UNHELPFUL_TO, 0)
        .when(any_of(V2_INFORMATIVE_FLAGS), 1)
        .when(any_of(V2_EMPTY_FLAGS), 0)
        .otherwise(1)
    )
    borderline = score.between(2, 3)
    clear = (score >= 6) | (score <= 0)
    base = F.when(borderline, 0.9 - 0.15 - 0.10).when(
        clear, F.least(F.lit(0.9 + 0.05), F.lit(0.99))
    ).otherwise(0.9)
    short = (F.col("_wc") <= 5) & ~F.array_contains(flags, "too_short_but_specific")
    confidence = clip(base - F.when(short, 0.05).otherwise(0.0), 0.5, 0.99)
    df = df.withColumns(
        {
            "is_helpful": label,
            "confidence": round_even(confidence, 2),
            "label_version": F.lit(LABEL_VERSION),
            "model": F.lit(model),
        }
    ).withColumn("reason", _reason(messages))
    fields = [
        "is_helpful", "helpfulness_score", "confidence", "reason", *RUBRIC_COLUMNS,
        "quality_flags", "label_version", "model",
    ]
    return df.select(*keep, *[F.col(f).alias(prefix + f) for f in fields])
