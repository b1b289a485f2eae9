import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewsift.functions import columns as c
from reviewsift.functions.features import eda_features, metadata_features, reason_codes, sample_weight
from reviewsift.functions.text import (
    canonical_ids, clean_corpus, clean_cloud_text, encoder_ready, nfc_corpus, with_review_text,
)
from reviewsift.schemas import METADATA_FEATURES


def one(spark, values, fn):
    df = spark.createDataFrame([(x,) for x in values], "x string")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


ODD = [" a b ", "", " x\x1c y　", "một hai", None]


def test_white_space_is_pythons(spark):
    python = lambda f: [None if x is None else f(x) for x in ODD]
    assert one(spark, ODD, c.collapse) == python(lambda x: " ".join(x.split()))
    assert one(spark, ODD, c.strip) == python(str.strip)
    assert one(spark, ODD, c.word_count) == python(lambda x: len(x.split()))


def test_round_even_is_numpys(spark):
    values = [0.125, 2.5, 3.5, 0.005, 1.005, 55.555]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(c.round_even(F.col("x"), 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in values]


def test_bucketize_edges(spark):
    df = spark.createDataFrame([(-1,), (0,), (5,), (6,), (999,), (None,)], "x int")
    edges, labels = (-1, 5, 10, float("inf")), ("1-5", "6-10", "11+")
    right = [r[0] for r in df.select(c.bucketize("x", edges, labels)).collect()]
    assert right == [None, "1-5", "1-5", "6-10", "11+", None]
    left = [r[0] for r in df.select(c.bucketize("x", edges, labels, right=False)).collect()]
    assert left == ["1-5", "1-5", "6-10", "6-10", "11+", None]
    with pytest.raises(ValueError):
        c.bucketize("x", (1, 2), ("a", "b"))


def test_model_cleaner(spark):
    df = spark.createDataFrame([(" <b>Pin</b>  TỐT https://a.b/c www.x.y\n",), (None,)], "t string")
    assert [r["clean_text"] for r in clean_corpus(df, "t").collect()] == ["pin tốt", ""]


def test_nfc(spark):
    df = spark.createDataFrame([(unicodedata.normalize("NFD", " Vải  mỏng "),), (None,)], "t string")
    assert [r["t"] for r in nfc_corpus(df, ["t"]).collect()] == ["Vải mỏng", ""]


def test_encoder_ready(spark):
    df = spark.createDataFrame([("Pin &amp; sạc​\x07 TỐT﻿",), (None,)], "t string")
    row, empty = encoder_ready(df, "t").collect()
    assert row["encoder_text"] == "Pin & sạc TỐT"
    assert (row["encoder_char_len"], row["encoder_word_count"]) == (13, 4)
    assert (empty["encoder_text"], empty["encoder_char_len"]) == ("", 0)


def test_review_text(spark):
    data = [("Tốt ", " pin khỏe."), ("", "abc"), (None, None), ("a", None)]
    df = spark.createDataFrame(data, "title string, content string")
    assert [r["review_text"] for r in with_review_text(df).collect()] == ["Tốt. pin khỏe", "abc", "", "a"]
    assert [r["t"] for r in with_review_text(df, " ", "t").collect()] == ["Tốt pin khỏe.", "abc", "", "a"]


def test_canonical_ids(spark):
    ids = [" manual_7", "MANUAL_00012", "Manual_1234567", "MANUAL_x", "other ", "manual_0"]
    df = spark.createDataFrame([(i,) for i in ids], "annotation_id string")
    assert [r[0] for r in canonical_ids(df).collect()] == [
        "MANUAL_00007", "MANUAL_00012", "MANUAL_1234567", "MANUAL_x", "other", "MANUAL_00000",
    ]


def test_cloud_text(spark):
    assert one(spark, ["Pin, TỐT! https://x.y 5★"], clean_cloud_text) == ["pin tốt 5"]


def test_metadata_golden_row(spark):
    df = spark.createDataFrame([("", "Pin dùng 6 giờ nhưng mic hơi rè!", 4)], "title string, content string, rating int")
    row = metadata_features(df).first()
    assert [row[n] for n in ("rating", "word_count", "has_content", "has_title")] == [4.0, 8.0, 1.0, 0.0]
    assert [row[n] for n in ("exclamation_count", "question_count", "digit_count")] == [1.0, 0.0, 1.0]
    assert [row[n] for n in ("is_low_rating", "is_high_rating", "is_extreme_rating")] == [0.0, 1.0, 0.0]
    assert row["uppercase_ratio"] == 1 / 32 and row["text_len"] == 32.0
    assert len(METADATA_FEATURES) == 14


def test_metadata_of_missing_values(spark):
    df = spark.createDataFrame([(None, None, None, None)], "title string, content string, rating string, word_count string")
    row = metadata_features(df).first()
    assert all(row[n] is not None for n in METADATA_FEATURES)
    assert row["is_low_rating"] == 1.0 and row["word_count"] == 0.0


def test_reason_codes(spark):
    texts = [
        "Pin dùng 6 giờ nhưng mic hơi rè!", "Tốt", "250ml", "pin và camera đẹp nhưng hơi nóng",
        " ".join(["từ"] * 25), None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "review_text string")
    assert [r["model_reason_codes"] for r in reason_codes(df).collect()] == [
        ["specific_experience", "mentions_product_features"],
        ["too_generic"],
        ["too_generic"],
        ["mentions_product_features", "mentions_pros_and_cons"],
        ["sufficient_detail"],
        ["too_generic"],
    ]


def test_sample_weight(spark):
    df = spark.createDataFrame([(0.3, 7), (1.2, 2), (0.8, -2)], "confidence double, helpfulness_score int")
    got = [round(r["sample_weight"], 9) for r in sample_weight(df).collect()]
    assert got == [0.5, round(0.85 + 0.15 / 9, 9), 0.8]


def test_eda_features_of_a_row(spark):
    df = spark.createDataFrame(
        [("Tốt", "Pin 5 giờ?! Hay... vậy", "2", "2024-02-05 13:00:00"), (None, None, None, None)],
        "title string, content string, helpful_count string, created_at string",
    ).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    row, empty = eda_features(df).collect()
    assert row["review_context"] == "Tốt. Pin 5 giờ?! Hay... vậy"
    assert (row["sentence_count"], row["exclamation_count"], row["question_count"]) == (3, 1, 1)
    assert (row["created_weekday"], row["created_hour"], row["has_helpful_vote"]) == ("Monday", 13, 1)
    assert (empty["sentence_count"], empty["review_word_length"], empty["helpful_count"]) == (1, 0, 0.0)
    assert empty["created_year"] is None


def test_only_some_texts_of_a_batch_are_python_strings_at_a_time():
    texts = [f"{i} &amp; é " + "x" * 20_000 for i in range(1_000)]
    batch = pa.array([*texts, None, ""])
    tracemalloc.start()
    out = c._unescape_nfc_batch.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.3 * batch.nbytes
    assert out.to_pylist() == [t.replace("&amp;", "&").replace("é", "é") for t in texts] + [None, ""]
    assert c._unescape_nfc_batch.func(batch.slice(0, 0)).to_pylist() == []
