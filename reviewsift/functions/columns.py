"""Small column expressions used across the operators (all native, code-generated)."""

from __future__ import annotations

import html
import math
import unicodedata
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# The characters Python treats as white space, as a Java character class body.
WHITE_SPACE = r"\s\x1c-\x1f\x85\p{Z}"


# Fixed value: the same characters one by one.
WHITE_CHARACTERS = "".join(
    map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    """Remove leading and trailing white space of any kind (``trim`` removes spaces only)."""
    return F.btrim(col(c), F.lit(WHITE_CHARACTERS))


def collapse(c: Column | str) -> Column:
    """Turn every run of white space into one space and strip the ends."""
    return F.trim(F.regexp_replace(col(c), rf"[{WHITE_SPACE}]+", " "))


def word_count(c: Column | str) -> Column:
    """Number of white-space separated words; 0 for an empty text."""
    return F.regexp_count(col(c), F.lit(f"[^{WHITE_SPACE}]+"))


def char_count(c: Column | str, symbol: str) -> Column:
    """Occurrences of one character."""
    return F.length(col(c)) - F.length(F.replace(col(c), F.lit(symbol), F.lit("")))


def class_count(c: Column | str, regex_class: str) -> Column:
    """Number of characters in a regex class such as ``\\p{Nd}``."""
    return F.length(col(c)) - F.length(F.regexp_replace(col(c), f"{regex_class}+", ""))


def digit_count(c: Column | str) -> Column:
    return class_count(c, r"\p{Nd}")


def round_even(c: Column, digits: int) -> Column:
    """Round half to even on the scaled value, as numeric Python libraries do."""
    scale = float(10**digits)
    return F.rint(c.cast("double") * scale) / scale


def percentage(c: Column, digits: int = 2) -> Column:
    return round_even(c * 100, digits)


def bool_int(c: Column) -> Column:
    """A boolean as 0/1 with NULL counted as false."""
    return F.coalesce(c, F.lit(False)).cast("int")


def safe_div(a: Column, b: Column, otherwise: float | None = None) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise).cast("double"))


def quote(term: str) -> str:
    """A literal term as a regex (works for Java and RE2)."""
    return "".join("\\" + ch if ch in r".^$*+?{}[]\|()-" else ch for ch in term)


def python_regex(pattern: str) -> str:
    """Unicode classes and ``\\n``-only line ends, the meaning of patterns in Python."""
    return "(?Ud)" + pattern


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(python_regex(pattern))


def flags_array(*conditions: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in conditions]))


def clip(c: Column, low: float, high: float) -> Column:
    """Clip to a range; NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def bucketize(
    c: Column | str,
    edges: Sequence[float],
    labels: Sequence[str],
    right: bool = True,
) -> Column:
    """Label of the interval a value falls in; NULL outside all intervals.

    ``right=True`` closes intervals on the right, ``(a, b]``; otherwise ``[a, b)``. Infinite
    edges leave an end open.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("bucketize needs one more edge than labels")
    value = col(c)
    result = None
    for low, high, label in zip(edges[:-1], edges[1:], labels):
        tests = []
        if not math.isinf(low):
            tests.append(value > low if right else value >= low)
        if not math.isinf(high):
            tests.append(value <= high if right else value < high)
        inside = value.isNotNull()
        for test in tests:
            inside = inside & test
        result = F.when(inside, label) if result is None else result.when(inside, label)
    return result


# Fixed value: so many texts of an Arrow batch are Python strings at a time.
TEXTS_AT_ONCE = 64


def mapped(values: pa.Array, change: Callable[[str], object], kind: pa.DataType) -> pa.Array:
    """``change`` of each text of an Arrow batch, NULL for NULL.

    A batch holds up to 64 MB of texts; as Python strings, all at once, they and their results take a
    multiple of that in every worker.
    """
    parts = [
        pa.array([None if v is None else change(v) for v in values.slice(at, TEXTS_AT_ONCE).to_pylist()], kind)
        for at in range(0, len(values), TEXTS_AT_ONCE)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(T.StringType())
def _nfc_batch(texts: pa.Array) -> pa.Array:
    return mapped(texts, _nfc, texts.type)


@F.arrow_udf(T.StringType())
def _unescape_nfc_batch(texts: pa.Array) -> pa.Array:
    return mapped(texts, lambda t: _nfc(html.unescape(t)), texts.type)


def nfc(c: Column | str) -> Column:
    """Unicode NFC, which Spark has not built in. ASCII texts, as many bytes as characters, are NFC
    and stay in the JVM; Python gets a NULL in their place."""
    text = col(c)
    other = F.octet_length(text) != F.length(text)
    return F.coalesce(_nfc_batch(F.when(other, text)), text)


def unescape_nfc(c: Column | str) -> Column:
    """HTML entities resolved, then Unicode NFC, in one Arrow batch of the texts that need either."""
    text = col(c)
    needed = (F.octet_length(text) != F.length(text)) | text.contains("&")
    return F.coalesce(_unescape_nfc_batch(F.when(needed, text)), text)


def _nfc(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
