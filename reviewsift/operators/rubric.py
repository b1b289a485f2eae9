"""Rule rubric over review text, and flag refinement."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from reviewsift.functions.columns import (
    WHITE_SPACE, bool_int, collapse, flags_array, nfc, quote, python_regex, round_even,
    text_or_empty,
)
from reviewsift.functions.terms import decisive, has_any, hits, with_found_terms
from reviewsift.functions.text import join_title
from reviewsift.lexicon import Lexicon, VIETNAMESE
from reviewsift.messages import RUBRIC_REASONS
from reviewsift.operators.validate import needs_review
from reviewsift.schemas import LABEL_COLUMNS, RUBRIC_COLUMNS

# ---------------------------------------------------------------------------
# Thresholds and names of the first rubric.
# ---------------------------------------------------------------------------
LABEL_VERSION = "llm_helpfulness_v1_1"
LABEL_SOURCE = "codex_rule_adjudicated"
HELPFUL_FROM, UNHELPFUL_TO = 4, 1
LETTER_OR_DIGIT = r"[\p{L}\p{N}]"
WORD = r"[\p{L}\p{N}_]+"
NOT_PLAIN = rf"[^\p{{L}}\p{{N}}_À-ỹ{WHITE_SPACE}]"


def number_pattern(lexicon: Lexicon) -> str:
    units = "|".join(quote(u) for u in lexicon.number_units)
    return rf"(?i)\b\d+(?:[.,]\d+)?\s*(?:{units})?\b"


def generic_words_at_most(lexicon: Lexicon) -> int:
    """A bound of the words of a generic text: a term of n characters has at most (n + 1) / 2."""
    phrase = max(((len(p) + 1) // 2 for p in lexicon.generic_phrases), default=0)
    return max(phrase, 5 * max(((len(w) + 1) // 2 for w in lexicon.generic_words), default=0))


def is_generic(content: Column, lexicon: Lexicon) -> Column:
    """A known phrase, or up to five words that are all generic."""
    plain = collapse(F.regexp_replace(content, NOT_PLAIN, " "))
    word = "|".join(quote(w) for w in lexicon.generic_words)
    only_generic = plain.rlike(rf"^(?:{word})(?: (?:{word})){{0,4}}\z") if word else F.lit(False)
    return plain.isin(list(lexicon.generic_phrases)) | only_generic


def score_terms(lexicon: Lexicon) -> tuple[str, ...]:
    """Every term the points and flags look for in the content."""
    return (
        *lexicon.attributes, *lexicon.decision, *lexicon.defects,
        *decisive(lexicon.experience), *decisive(lexicon.shipping), *decisive(lexicon.spam),
        *decisive(lexicon.seller), *decisive(lexicon.comparison), *decisive(lexicon.size_fit),
        *decisive(lexicon.durability), *decisive(lexicon.packaging),
    )


def refine_terms(lexicon: Lexicon) -> tuple[str, ...]:
    """Every term the flag refinement looks for in title and content."""
    return (
        *decisive(lexicon.refine_defects), *decisive(lexicon.refine_durability),
        *decisive(lexicon.refine_comparison),
    )


def _signals(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The facts about a text that points, flags and label are built from."""
    content, found = F.col("_content"), F.col("_found")
    df = df.withColumns(
        {
            "_attributes": hits(found, lexicon.attributes),
            "_decisions": hits(found, lexicon.decision),
            "_defects": hits(found, lexicon.defects),
            "_experience": has_any(found, lexicon.experience),
            "_shipping": has_any(found, lexicon.shipping),
            "_number": content.rlike(python_regex(number_pattern(lexicon))),
            "_words": F.regexp_count(content, F.lit(WORD)),
            "_noise": ~content.rlike(LETTER_OR_DIGIT),
            "_spam": has_any(found, lexicon.spam),
        }
    )
    # Cleaning keeps the number of words, so only short texts are cleaned and compared.
    short = F.col("_words") <= generic_words_at_most(lexicon)
    df = df.withColumn("_generic", short & is_generic(content, lexicon))
    return df.withColumns(
        {
            "_n_attr": F.size("_attributes"),
            "_n_dec": F.size("_decisions"),
            "_n_def": F.size("_defects"),
        }
    ).withColumn(
        "_shipping_only",
        F.col("_shipping")
        & (F.col("_n_attr") + F.col("_n_dec") + F.col("_n_def") == 0)
        & ~F.col("_experience"),
    )


def _points() -> dict[str, Column]:
    attr, dec, defect = F.col("_n_attr") > 0, F.col("_n_dec") > 0, F.col("_n_def") > 0
    number, words = F.col("_number"), F.col("_words")
    experience, generic = F.col("_experience"), F.col("_generic")
    empty_praise = generic | F.col("_shipping_only")
    several = F.col("_n_attr") >= 2

    rich = number | several | (F.col("_n_dec") >= 2) | (defect & (words >= 4))
    some = attr | number | dec | defect
    specificity = (
        F.when(generic & (words <= 3), 0)
        .when(rich & ~empty_praise, 2)
        .when(some, 1)
        .otherwise(0)
    )
    lived = experience & ~empty_praise
    product_experience = (
        F.when(lived & (number | attr | (words >= 20)), 2).when(lived, 1).otherwise(0)
    )
    decision_value = (
        F.when(empty_praise, 0)
        .when(several | dec | defect | (attr & number), 2)
        .when(attr, 1)
        .otherwise(0)
    )
    values = {
        "specificity": specificity,
        "product_experience": product_experience,
        "decision_value": decision_value,
        "clarity": bool_int(words >= 1),
        "noise_penalty": F.when(F.col("_spam") & ~attr, -1).otherwise(0),
    }
    when_noise = {name: (-2 if name == "noise_penalty" else 0) for name in values}
    return {
        name: F.when(F.col("_noise"), when_noise[name]).otherwise(value)
        for name, value in values.items()
    }


def _reason(messages: Mapping[str, str]) -> Column:
    def listed(kind: str, hits: str) -> Column:
        first = F.array_join(F.slice(hits, 1, 3), ", ")
        return F.concat(F.lit(messages[kind] + " "), first, F.lit("."))

    parts = F.array_compact(
        F.array(
            F.when(F.col("_n_attr") > 0, listed("attributes", "_attributes")),
            F.when(F.col("_number"), messages["number"]),
            F.when(F.col("_experience"), messages["experience"]),
            F.when(F.col("_n_dec") > 0, messages["decision"]),
            F.when(F.col("_n_def") > 0, listed("defects", "_defects")),
            F.when(F.col("_shipping_only"), messages["shipping"]),
        )
    )
    return (
        F.when(F.col("_noise"), messages["noise"])
        .when(F.col("_generic"), messages["generic"])
        .when(F.size(parts) == 0, messages["other"])
        .otherwise(F.array_join(parts, " "))
    )


def rubric_score(
    df: DataFrame,
    lexicon: Lexicon = VIETNAMESE,
    messages: Mapping[str, str] = RUBRIC_REASONS,
    normalize: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """R1 (with R2): points, score, label, flags, confidence, reason and review need.

    Needs `annotation_id`, `title` and `content`; a `manual_label` column breaks ties. With
    ``normalize=False`` the texts must be NFC already, and the plan stays in the JVM. The
    result has the id, the label columns and those of ``keep``.
    """
    clean = (lambda c: collapse(nfc(text_or_empty(c)))) if normalize else (
        lambda c: collapse(text_or_empty(c))
    )
    if "manual_label" in df.columns:
        human = F.coalesce(F.col("manual_label").cast("string"), F.lit("nan"))
    else:
        human = F.lit("uncertain")
    df = df.withColumns({"_title": clean("title"), "_clean": clean("content"), "_human": human})
    df = df.withColumns(
        {"_content": F.lower("_clean"), "_text": F.lower(join_title("_title", "_clean"))}
    )
    # Every Python step comes before the native ones: a UDF above them would make the optimizer
    # inline the whole chain of expressions into one.
    df = with_found_terms(df, "_content", score_terms(lexicon), "_found")
    df = with_found_terms(df, "_text", refine_terms(lexicon), "_refine")
    df = _signals(df, lexicon).withColumns(_points())
    df = df.withColumn("helpfulness_score", sum((F.col(c) for c in RUBRIC_COLUMNS), F.lit(0)))

    score, binary = F.col("helpfulness_score"), F.col("_human").isin("0", "1")
    concrete = (F.col("_n_attr") + F.col("_n_dec") + F.col("_n_def") > 0) | F.col("_number")
    label = (
        F.when(score >= HELPFUL_FROM, 1)
        .when(score <= UNHELPFUL_TO, 0)
        .when(concrete, 1)
        .when(binary, F.col("_human").try_cast("int"))
        .otherwise(0)
    )
    df = df.withColumn("is_helpful", label)
    agrees = F.col("_human") == F.col("is_helpful").cast("string")
    base = (
        F.when(score.between(2, 3), F.when(F.col("_human") == "uncertain", 0.62).otherwise(0.68))
        .when(score.isin(1, 4), 0.82)
        .otherwise(0.92)
    )
    confidence = (
        F.when(binary & agrees, F.least(F.lit(0.96), base + 0.04))
        .when(binary, F.least(F.lit(0.72), base))
        .otherwise(base)
    )
    found, has_attr = F.col("_found"), F.col("_n_attr") > 0
    flags = flags_array(
        ("ambiguous", score.between(2, 3) | (binary & ~agrees)),
        ("noise_text", F.col("_noise")),
        ("generic_only", F.col("_generic")),
        ("shipping_only", F.col("_shipping_only")),
        ("seller_service_only", has_any(found, lexicon.seller) & ~has_attr),
        ("too_short_but_specific", (F.col("_words") <= 5) & has_attr & ~F.col("_generic")),
        ("contains_product_defect", F.col("_n_def") > 0),
        ("contains_usage_context", F.col("_experience") | F.col("_number")),
        ("contains_comparison", has_any(found, lexicon.comparison)),
        ("contains_size_fit_info", has_any(found, lexicon.size_fit)),
        ("contains_durability_info", has_any(found, lexicon.durability)),
        ("contains_packaging_info", has_any(found, lexicon.packaging)),
    )
    df = df.withColumns(
        {
            "confidence": round_even(confidence, 3),
            "reason": _reason(messages),
            "quality_flags": flags,
            "label_version": F.lit(LABEL_VERSION),
            "label_source": F.lit(LABEL_SOURCE),
            "adjudicated": F.lit(True),
        }
    )
    refined = _refined(df, F.col("_refine"), lexicon)
    return refined.select("annotation_id", *keep, *LABEL_COLUMNS)


def refine_flags(
    df: DataFrame, text: Column | str, lexicon: Lexicon = VIETNAMESE
) -> DataFrame:
    """R2: drop flags that contradict the label or lack support in the text, add comparison,
    and recompute the review need. ``text`` is title plus content."""
    text = F.lower(F.col(text) if isinstance(text, str) else text)
    df = with_found_terms(df.withColumn("_low", text), "_low", refine_terms(lexicon), "_refine")
    return _refined(df, F.col("_refine"), lexicon).drop("_refine", "_low")


def _refined(df: DataFrame, found: Column, lexicon: Lexicon) -> DataFrame:
    helpful = F.col("is_helpful")
    unsupported = flags_array(
        ("too_short_but_specific", helpful == 0),
        ("generic_only", helpful == 1),
        ("contains_product_defect", ~has_any(found, lexicon.refine_defects)),
        ("contains_durability_info", ~has_any(found, lexicon.refine_durability)),
    )
    added = flags_array(
        ("contains_comparison", has_any(found, lexicon.refine_comparison))
    )
    flags = F.array_sort(
        F.array_union(F.array_except("quality_flags", unsupported), added)
    )
    return df.withColumn("quality_flags", flags).withColumn(
        "needs_human_review", needs_review(F.col("confidence"), F.col("quality_flags"))
    )
