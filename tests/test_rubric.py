import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from reviewsift.functions import terms
from reviewsift.lexicon import VIETNAMESE, VIETNAMESE_PATTERNS, from_table
from reviewsift.operators.rubric import WORD, generic_words_at_most, is_generic, refine_flags, rubric_score
from reviewsift.operators.rubric_v2 import rubric_score_v2

SHIRT = "Vải mỏng nhưng mặc mát"
SHIRT_POINTS = (2, 2, 2, 1, 0)
# content, human label -> points, label, confidence, flags, needs review
ROWS = [
    ("Pin yếu, dùng 2 giờ là hết", "1", (2, 0, 2, 1, 0), 1, 0.96, ["contains_usage_context"], False),
    ("ok", None, (0, 0, 0, 1, 0), 0, 0.82, ["generic_only"], False),
    ("!!! 😀", "uncertain", (0, 0, 0, 0, -2), 0, 0.92, ["noise_text"], False),
    ("Shop giao hàng nhanh", None, (0, 0, 0, 1, 0), 0, 0.82, ["seller_service_only", "shipping_only"], False),
    (SHIRT, "0", SHIRT_POINTS, 1, 0.72, ["ambiguous", "contains_usage_context", "too_short_but_specific"], True),
    (unicodedata.normalize("NFD", SHIRT), None, SHIRT_POINTS, 1, 0.92,
     ["contains_usage_context", "too_short_but_specific"], False),
    ("Mình thử rồi", "1", (0, 1, 0, 1, 0), 1, 0.72, ["ambiguous", "contains_usage_context"], True),
    ("Mình thử rồi", "uncertain", (0, 1, 0, 1, 0), 0, 0.62, ["ambiguous", "contains_usage_context"], True),
    ("Mình thử rồi", None, (0, 1, 0, 1, 0), 0, 0.68, ["ambiguous", "contains_usage_context"], True),
    (" ", None, (0, 0, 0, 0, -2), 0, 0.92, ["noise_text"], False),
    (None, None, (0, 0, 0, 0, -2), 0, 0.92, ["noise_text"], False),
    ("Đánh giá nhận xu", None, (0, 0, 0, 1, -1), 0, 0.92, [], False),
    ("Máy lỗi, rẻ hơn chỗ khác", None, (2, 0, 2, 1, 0), 1, 0.92,
     ["contains_comparison", "contains_product_defect"], False),
    ("Bền", None, (1, 0, 1, 1, 0), 1, 0.68,
     ["ambiguous", "contains_durability_info", "too_short_but_specific"], True),
]


def scored(spark, rows, **options):
    data = [(str(i), "", r[0], r[1]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(
        data, "annotation_id string, title string, content string, manual_label string"
    )
    out = rubric_score(df, **options).collect()
    return sorted(out, key=lambda r: int(r["annotation_id"]))


def check(row, expected):
    _, _, points, label, confidence, flags, review = expected
    names = ("specificity", "product_experience", "decision_value", "clarity", "noise_penalty")
    assert tuple(row[n] for n in names) == points
    assert row["helpfulness_score"] == sum(points)
    assert row["is_helpful"] == label
    assert row["confidence"] == confidence
    assert row["quality_flags"] == flags
    assert row["needs_human_review"] == review
    assert row["reason"]


def test_hand_worked_rows(spark):
    for row, expected in zip(scored(spark, ROWS), ROWS):
        check(row, expected)


def test_decisive_terms_decide():
    assert terms.decisive(("ab", "abc", "x", "xab", "", "ab")) == ("ab", "x")


def test_gate_agrees_with_the_regex(spark):
    """Patterns that start with a group, with branches, nested groups, classes and escapes after it."""
    rng = random.Random(3)
    tails = ["x", "|c", "x|c", "(y|z)", "(y|z)|c", "[|]", r"\|", "[^|]c", "(?:a|(b|c))x", "+", ".{0,3}c|x", "[]|]x"]
    patterns = ["(a|b)" + "".join(rng.sample(tails, rng.randint(0, 3))) for _ in range(60)]
    texts = ["", None] + ["".join(rng.choice("abcxyz|") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df = terms.with_found_terms(df, "t", terms.pattern_terms(patterns), "found")
    wrong = df.select(
        *[
            F.count_if(~terms.occurs(F.col("t"), F.col("found"), p).eqNullSafe(F.col("t").rlike(p))).alias(str(i))
            for i, p in enumerate(patterns)
        ]
    ).first()
    assert not any(wrong), [p for p, n in zip(patterns, wrong) if n]


def test_missing_human_column_counts_as_uncertain(spark):
    df = spark.createDataFrame([("1", "", "Mình thử rồi")], "annotation_id string, title string, content string")
    assert rubric_score(df).first()["confidence"] == 0.62


def test_empty_table(spark):
    assert scored(spark, ROWS[:1])[0]["is_helpful"] == 1
    df = spark.createDataFrame([], "annotation_id string, title string, content string")
    assert rubric_score(df).count() == 0


def test_refine_adds_and_drops_flags(spark):
    data = [
        (1, 0.9, ["generic_only", "contains_product_defect"], "so với loại cũ"),
        (0, 0.9, ["too_short_but_specific", "contains_durability_info"], "rất bền"),
        (0, 0.65, [], "hộp MÓP"),
    ]
    df = spark.createDataFrame(data, "is_helpful int, confidence double, quality_flags array<string>, t string")
    got = [(r["quality_flags"], r["needs_human_review"]) for r in refine_flags(df, "t").collect()]
    assert got == [(["contains_comparison"], False), (["contains_durability_info"], False), ([], True)]


def test_lexicon_from_table(spark):
    df = spark.createDataFrame([("attributes", "battery"), ("attributes", "screen")], "category string, term string")
    lexicon = from_table(df)
    assert set(lexicon.attributes) == {"battery", "screen"}
    assert lexicon.decision == VIETNAMESE.decision


def v2(spark, texts):
    df = spark.createDataFrame([(str(i), t, "") for i, t in enumerate(texts)],
                               "annotation_id string, review_text string, content string")
    rows = rubric_score_v2(df, prefix="").collect()
    return sorted(rows, key=lambda r: int(r["annotation_id"]))


def test_v2_rows(spark):
    rows = v2(spark, ["!!!", "aaaaaaaa tốt quá đi", "a b c d e f g a b c d e f g", "Pin yếu", None])
    noise, repeat, double, battery, empty = rows
    assert (noise["noise_penalty"], noise["helpfulness_score"], noise["is_helpful"]) == (-2, -2, 0)
    assert noise["quality_flags"] == ["generic_only", "noise_text"] and noise["confidence"] == 0.9
    assert (repeat["clarity"], repeat["noise_penalty"]) == (0, -1)
    assert "duplicate_like" in double["quality_flags"] and "duplicate_like" not in repeat["quality_flags"]
    assert (battery["specificity"], battery["decision_value"], battery["clarity"]) == (1, 0, 0)
    assert battery["quality_flags"] == ["too_short_but_specific"] and battery["confidence"] == 0.9
    assert empty["helpfulness_score"] == 0 and empty["is_helpful"] == 0


def test_v2_borderline_costs_both_deductions(spark):
    row = v2(spark, ["Pin yếu lắm nhé bạn"])[0]
    assert row["helpfulness_score"] == 2
    assert "ambiguous" in row["quality_flags"] and row["confidence"] == 0.65


@pytest.mark.parametrize(
    "pattern, expected",
    [
        (r"(a b|c)", (("a b", "c"), True)),
        (r"(pin|sạc).{0,30}\d", (("pin", "sạc"), False)),
        (r"(tã.{0,20}(x|y))", ((), False)),
        (r"(a|b)?c", ((), False)),
        (r"\d+ (a|b)", ((), False)),
    ],
)
def test_leading_terms(pattern, expected):
    assert terms.leading_terms(pattern) == expected


@pytest.mark.parametrize(
    "pattern, expected",
    [
        (r"(thiếu.{0,20}(hàng|quà))", ("thiếu",)),
        (r"(mỏng.{0,15}nhưng|dày.{0,15}nhưng)", ("mỏng", "dày")),
        (r"anh chị.{0,3}(x|y)", ("anh chị",)),
        (r"(sp\b|pin|lần \d+)", ("sp", "pin", "lần ")),
        (r"((ab|c)d|e)f", ("ab", "c", "e")),
        (r"colou?r|x+y", ("colo", "x")),
        (r"ab{0,2}c", ("a",)),
        (r"[|(]a|b", ()), (r"a|\d", ()), (r"(a)?b", ()), (r"(a){0}b", ()), (r"(?:a|b)c", ()), (r"x?y", ()), (r"", ()),
        (r"a|", ()), (r"(a|)b", ()), (r"\(a", ()),
    ],
)
def test_first_terms(pattern, expected):
    assert terms.first_terms(pattern) == expected


def test_every_match_has_a_first_term():
    random.seed(5)
    for pattern in VIETNAMESE_PATTERNS.every():
        some, found = terms.leading_terms(pattern)[0] or terms.first_terms(pattern), re.compile(pattern)
        pieces = [*re.findall(r"[^()|\\.\[\]{}?*+^$\d,]+", pattern), " ", "7", "x"]
        texts = ["".join(random.choices(pieces, k=6)) for _ in range(300)]
        assert not some or all(any(t in text for t in some) for text in texts if found.search(text))
    gated = [p for p in VIETNAMESE_PATTERNS.every() if terms.first_terms(p)]
    assert len(gated) == len(VIETNAMESE_PATTERNS.every()) - 2


def test_found_terms_equals_substring_search(spark):
    wanted = ("da", "dạ dày", "độ bền", "bền", "x.y", "it's", "", "da", "ÿ", "]ộ", "😀 ok", "\x7f")
    texts = ["đang da", "độ bền tốt", "dạ dày", "x.y it's", "", None, "be\u0302\u0300n", "ộ bền", "]ộ", "a😀 ok", "\x7f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in terms.with_found_terms(df, "t", wanted, "f").select("f").collect()]
    wanted = {w for w in wanted if w}
    assert terms.with_found_terms(df, "t", (), "f").select("f").first()[0] == []
    for list_ in (["da"], ["ề"]):
        some = terms.with_found_terms(df, "t", list_, "f").select("f").collect()
        assert [r[0] for r in some] == [None if t is None else [w for w in list_ if w in t] for t in texts]
    expected = [None if t is None else sorted(w for w in wanted if w in t) for t in texts]
    assert [g if g is None else sorted(g) for g in got] == expected
    both = df.select(terms.hits(F.array(F.lit("it's"), F.lit("da")), ("da", "dạ dày", "it's"))).first()[0]
    assert both == ["da", "it's"]


def test_long_texts_are_not_cleaned_to_see_that_they_are_not_generic(spark):
    most = generic_words_at_most(VIETNAMESE)
    words = max(VIETNAMESE.generic_words, key=len)
    longest = max(VIETNAMESE.generic_phrases, key=len)
    texts = [longest, f"{longest} !!! ... ?", " ".join([words] * 5), "... ".join([words] * 5), "x " * (most + 1), f"{longest} x", ""]
    df = spark.createDataFrame([(str(i), "", t) for i, t in enumerate(texts)], "annotation_id string, title string, content string")
    lowered = df.withColumn("_c", F.lower("content"))
    assert all(r[0] <= most for r in lowered.where(is_generic(F.col("_c"), VIETNAMESE)).select(F.regexp_count("_c", F.lit(WORD))).collect())
    expected = {r[0]: r[1] for r in lowered.select("annotation_id", is_generic(F.col("_c"), VIETNAMESE)).collect()}
    got = {r[0]: "generic_only" in r[1] for r in rubric_score(df).where("is_helpful = 0").select("annotation_id", "quality_flags").collect()}
    assert len(got) >= 5 and all(expected[k] == v for k, v in got.items()) and any(got.values())
