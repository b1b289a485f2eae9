"""Feature jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewsift.functions.columns import (
    bool_int, char_count, class_count, clip, col, digit_count, flags_array, matches, quote,
    strip, text_or_empty, word_count,
)
from reviewsift.functions.terms import decisive, has_any, hits, with_found_terms
from reviewsift.functions.text import join_title
from reviewsift.lexicon import Lexicon, VIETNAMESE
from reviewsift.schemas import METADATA_FEATURES

FEATURE_WORDS_MIN = 2
DETAIL_WORDS = 25
GENERIC_WORDS_MAX = 8


def metadata_features(df: DataFrame) -> DataFrame:
    """the 14 metadata features as doubles.

    Needs `title`, `content` and `rating`; a stored `word_count` is preferred over the
    computed one.
    """
    title, content = text_or_empty("title"), text_or_empty("content")
    text = F.col("_model_text")
    rating = F.coalesce(F.col("rating").try_cast("double"), F.lit(0.0))
    computed = word_count(text).cast("double")
    stored = F.col("word_count").try_cast("double") if "word_count" in df.columns else None
    features = {
        "rating": rating,
        "word_count": computed if stored is None else F.coalesce(stored, computed),
        "content_len": F.length(content),
        "title_len": F.length(title),
        "text_len": F.length(text),
        "has_title": strip(title) != "",
        "has_content": strip(content) != "",
        "exclamation_count": char_count(text, "!"),
        "question_count": char_count(text, "?"),
        "digit_count": digit_count(text),
        "uppercase_ratio": class_count(text, r"\p{IsUppercase}")
        / F.greatest(F.length(text), F.lit(1)),
        "is_low_rating": rating <= 2,
        "is_high_rating": rating >= 4,
        "is_extreme_rating": rating.isin(1.0, 5.0),
    }
    return (
        df.withColumn("_model_text", join_title("title", "content", " "))
        .withColumns({name: features[name].cast("double") for name in METADATA_FEATURES})
        .drop("_model_text")
    )


def eda_features(df: DataFrame) -> DataFrame:
    """text, calendar and vote features of the exploration reports."""
    title, content = strip(text_or_empty("title")), strip(text_or_empty("content"))
    votes = F.coalesce(F.col("helpful_count").try_cast("double"), F.lit(0.0))
    created = F.col("created_at")
    return df.withColumns(
        {"review_context": join_title("title", "content"), "helpful_count": votes}
    ).withColumns(
        {
            "review_char_length": F.length("review_context"),
            "review_word_length": word_count("review_context"),
            "title_char_length": F.length(title),
            "content_char_length": F.length(content),
            "sentence_count": F.greatest(
                F.lit(1), F.regexp_count("review_context", F.lit("[.!?]+"))
            ),
            "exclamation_count": char_count("review_context", "!"),
            "question_count": char_count("review_context", "?"),
            "digit_count": digit_count("review_context"),
            "created_year": F.year(created),
            "created_month": F.month(created),
            "created_hour": F.hour(created),
            "created_weekday": F.date_format(created, "EEEE"),
            "has_helpful_vote": bool_int(F.col("helpful_count") > 0),
        }
    )


def sample_weight_of(confidence: Column | str, score: Column | str) -> Column:
    certainty = clip(F.abs(col(score) - 2.5) / 4.5, 0.0, 1.0)
    return clip(col(confidence).cast("double"), 0.5, 1.0) * (0.85 + 0.15 * certainty)


def sample_weight(df: DataFrame, output: str = "sample_weight") -> DataFrame:
    """training weight from label confidence and distance to the borderline scores."""
    return df.withColumn(output, sample_weight_of("confidence", "helpfulness_score"))


def quantity_pattern(lexicon: Lexicon) -> str:
    units = "|".join(quote(u) for u in lexicon.quantity_units)
    return rf"\b\d+\s*({units})?\b"


def reason_terms(lexicon: Lexicon) -> tuple[str, ...]:
    """Every term the reason codes look for."""
    return (*lexicon.feature_words, *decisive(lexicon.pros), *decisive(lexicon.cons))


def _codes(text: Column, words: Column, found: Column, lexicon: Lexicon) -> Column:
    return flags_array(
        ("specific_experience", matches(text, quantity_pattern(lexicon))),
        (
            "mentions_product_features",
            F.size(hits(found, lexicon.feature_words)) >= FEATURE_WORDS_MIN,
        ),
        (
            "mentions_pros_and_cons",
            has_any(found, lexicon.pros) & has_any(found, lexicon.cons),
        ),
        ("sufficient_detail", words >= DETAIL_WORDS),
    )


def reason_codes(
    df: DataFrame,
    column: str = "review_text",
    lexicon: Lexicon = VIETNAMESE,
    output: str = "model_reason_codes",
) -> DataFrame:
    """add the reason codes of a review text, in a fixed order."""
    # One step per shared value, so that none is computed twice.
    df = df.withColumn("_low", F.lower(text_or_empty(column)))
    df = with_found_terms(df, "_low", reason_terms(lexicon), "_found")
    df = df.withColumn("_n_words", word_count("_low"))
    df = df.withColumn("_codes", _codes(F.col("_low"), F.col("_n_words"), F.col("_found"), lexicon))
    generic = (F.size("_codes") == 0) & (F.col("_n_words") <= GENERIC_WORDS_MAX)
    codes = F.when(generic, F.array(F.lit("too_generic"))).otherwise(F.col("_codes"))
    return df.withColumn(output, codes).drop("_low", "_found", "_n_words", "_codes")


def derived_flags(df: DataFrame) -> DataFrame:
    """`purchased_int` and `word_count` of the joined review text."""
    return df.withColumns(
        {
            "purchased_int": bool_int(F.col("purchased")),
            "word_count": word_count("review_text"),
        }
    )
