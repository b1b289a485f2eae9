"""Text normalisation jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewsift.functions.columns import (
    col, collapse, nfc, strip, text_or_empty, unescape_nfc, word_count,
)

# ---------------------------------------------------------------------------
# What the cleaners remove or keep.
# ---------------------------------------------------------------------------
TAG = r"<[^>]+>"
URL = r"https?://\S+|www\.\S+"
CONTROL_OR_INVISIBLE = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\u200b\ufeff]"
NOT_CLOUD_TEXT = r"[^0-9a-zA-ZÀ-ỹ\s]"
ANNOTATION_ID = r"(?i)^MANUAL_(\d+)$"


def clean_model_text(c: Column | str) -> Column:
    """Lower-case text without tags and URLs, white space collapsed; NULL becomes ''."""
    text = F.lower(strip(text_or_empty(c)))
    text = F.regexp_replace(text, TAG, " ")
    text = F.regexp_replace(text, "(?U)" + URL, " ")
    return collapse(text)


def clean_corpus(df: DataFrame, column: str, output: str = "clean_text") -> DataFrame:
    """The text a model is trained on and scored with."""
    return df.withColumn(output, clean_model_text(column))


def nfc_corpus(df: DataFrame, columns: list[str]) -> DataFrame:
    """NFC plus collapsed white space for each column; NULL becomes ''."""
    return df.withColumns({c: collapse(nfc(text_or_empty(c))) for c in columns})


def encoder_ready(df: DataFrame, column: str, output: str = "encoder_text") -> DataFrame:
    """Text for a pretrained encoder, with character and word counts before and after.

    Entities are resolved, NFC is applied and control or invisible characters become spaces;
    case, accents and stop words stay.
    """
    before = text_or_empty(column)
    after = collapse(F.regexp_replace(unescape_nfc(before), CONTROL_OR_INVISIBLE, " "))
    return (
        df.withColumn(output, after)
        .withColumns(
            {
                "char_len": F.length(before),
                "word_count_computed": word_count(before),
                "encoder_char_len": F.length(output),
                "encoder_word_count": word_count(output),
            }
        )
    )


def join_title(title: Column | str, content: Column | str, separator: str = ". ") -> Column:
    """Title and content as one text.

    The default joins with a full stop and trims stops and spaces; a blank separator joins
    with a space and collapses white space, as model inputs need.
    """
    if separator == " ":
        return collapse(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(content)))
    joined = F.concat(strip(text_or_empty(title)), F.lit(separator), strip(text_or_empty(content)))
    return F.btrim(joined, F.lit(separator))


def with_review_text(
    df: DataFrame, separator: str = ". ", output: str = "review_text"
) -> DataFrame:
    """T4: add the joined review text."""
    return df.withColumn(output, join_title("title", "content", separator))


def canonical_id(c: Column | str) -> Column:
    """`manual_7` -> `MANUAL_00007`; other ids are only stripped."""
    stripped = strip(col(c).cast("string"))
    digits = F.regexp_extract(stripped, ANNOTATION_ID, 1)
    number = F.when(
        F.length(F.regexp_replace(digits, "^0+", "")) < 5,
        F.lpad(F.regexp_replace(digits, "^0+", ""), 5, "0"),
    ).otherwise(F.regexp_replace(digits, "^0+", ""))
    return F.when(digits == "", stripped).otherwise(F.concat(F.lit("MANUAL_"), number))


def canonical_ids(df: DataFrame, column: str = "annotation_id") -> DataFrame:
    """T5: canonical annotation ids."""
    return df.withColumn(column, canonical_id(column))


def clean_cloud_text(c: Column | str) -> Column:
    """Lower-case letters and digits only, for word frequencies."""
    text = F.regexp_replace(F.lower(text_or_empty(c)), "(?U)" + URL, " ")
    return collapse(F.regexp_replace(text, "(?U)" + NOT_CLOUD_TEXT, " "))
