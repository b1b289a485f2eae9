"""Review-shaped views over the supplied tables (documents, events, labels, embeddings).

The supplied tables hold no reviews, so these views derive every column a review table needs
from them: whole texts, every document, every label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewsift.functions.columns import flags_array
from reviewsift.functions.features import derived_flags
from reviewsift.functions.text import with_review_text
from reviewsift.lexicon import PatternSet, VIETNAMESE
from reviewsift.models.embed import hash_embed
from reviewsift.operators.gold import gold_join
from reviewsift.schemas import RUBRIC_COLUMNS
from reviewsift.sources.io import spread

TEST_LEXICON = VIETNAMESE.with_terms(
    generic_phrases=["lorem ipsum", "the of"],
    generic_words=["the", "of", "and", "de", "la", "der", "que", "to"],
    attributes=[" nicht ", " dans ", " pour ", " here ", " anwh ", " ndnd "],
    experience=[" sich ", " only ", " reat "],
    decision=[" tion ", " oned ", " hely "],
    shipping=[" than ", " onan "],
    defects=[" inan ", " reed ", " erre "],
    seller=[" onan "],
    spam=[" anth ", " onat "],
    comparison=[" reen ", " enst "],
    size_fit=[" anea ", " anan "],
    durability=[" ener "],
    packaging=[" heat ", " ines "],
    number_units=["km", "kg", "%"],
    refine_defects=[" inan ", " reed ", " thth "],
    refine_durability=[" ener ", " onou "],
    refine_comparison=[" reen ", " oure "],
    feature_words=[" nicht ", " pour ", " only ", " thnt ", " erin ", " anea ", " les "],
    pros=[" tion ", " ther ", " est "],
    cons=[" than ", " dans ", " das "],
    quantity_units=["km", "mah", "%"],
    stop_words=["the", "of", "and", "de", "la", "der", "que"],
)

TEST_PATTERNS = PatternSet(
    specific_strong=(r"\d+\s*(km|kg)", r"( nicht | pour )", r"( here ).{0,30}(the|of)", " ndnd "),
    specific_medium=(r"( anwh | erre )", r"( than ).{0,20}(and|to)"),
    not_used_yet=r"( inor )",
    experience=(r"( sich | only ).{0,50}(the|die|of)", r"( reat )", r"( onan ).{0,10}( is| en)"),
    decision_strong=(r"( tion ).{0,30}(the|de)", r"( hely )"),
    decision_medium=(r"( oned )", r"( thth ).{0,30}(in|er)", r"( und )"),
    spam=(r"( anth ).{0,30}(of|the)", r"( onat )"),
    flags=(
        ("shipping", r"( than | onan )"),
        ("product", r"( dans | thnt | sp\b)"),
        ("seller", r"( ther | les\b)"),
        ("contains_product_defect", r"( inan | reed )"),
        ("contains_usage_context", r"( erin | pour )"),
        ("contains_comparison", r"( reen | enst )"),
        ("contains_size_fit_info", r"( anea ).{0,20}(the|of)"),
        ("contains_durability_info", r"( ener |sau \d+ km)"),
        ("contains_packaging_info", r"( heat ).{0,60}(and|to)"),
        ("possible_fake_or_spam", r"( ines )"),
    ),
)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def documents(spark: SparkSession, directory: str, only: DataFrame | None = None) -> DataFrame:
    """Whole documents, or those whose `doc_id` is in ``only``."""
    docs = table(spark, directory, "documents")
    return spread(docs if only is None else docs.join(only, "doc_id", "left_semi"))


def pages(spark: SparkSession, directory: str) -> DataFrame:
    return spread(table(spark, directory, "pages"))


def reviews(spark: SparkSession, directory: str, only: DataFrame | None = None) -> DataFrame:
    """One review per document, with user, votes, rating and dates from its event."""
    docs = documents(spark, directory, only)
    events = table(spark, directory, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("user_id"),
        "event_type",
        "ts",
        F.floor(F.col("value") / 10).cast("int").alias("helpful_count"),
        F.col("value").alias("_value"),
        F.get_json_object("props", "$.k").cast("int").alias("_k"),
    )
    words = F.split("text", " ")
    untitled = F.col("event_type") == "signup"
    number = F.col("doc_id").cast("string")
    padded = F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)
    rest = F.array_join(F.slice(words, F.lit(4), F.greatest(F.size(words), F.lit(1))), " ")
    human = F.when(F.col("event_type") == "view", "uncertain").when(
        F.col("event_type") != "signup", F.when(F.col("_value") >= 20, "1").otherwise("0")
    )
    rating = F.when((F.col("event_type") == "error") & (F.col("_k") < 50), None).otherwise(
        1 + F.col("_k") % 5
    )
    return docs.join(events, F.col("event_id") == F.col("doc_id")).select(
        "doc_id",
        number.alias("review_id"),
        F.concat(F.lit("MANUAL_"), padded).alias("annotation_id"),
        F.col("source").alias("product_id"),
        "user_id",
        F.lit("").alias("product_name"),
        F.col("lang").alias("category"),
        rating.cast("int").alias("rating"),
        F.when(untitled, "").otherwise(F.array_join(F.slice(words, 1, 3), " ")).alias("title"),
        F.when(untitled, F.col("text")).otherwise(rest).alias("content"),
        F.expr("timestampadd(DAY, _k * 9, ts)").alias("created_at"),
        F.col("ts").alias("crawled_at"),
        "helpful_count",
        (F.col("event_type") == "purchase").alias("purchased"),
        F.concat(F.lit("group_"), F.col("lang")).alias("sample_group"),
        human.alias("manual_label"),
        F.concat(F.col("source"), F.lit(".csv")).alias("source_file"),
    )


def review_rows(spark: SparkSession, directory: str) -> DataFrame:
    """Reviews with joined text, word count and purchase flag."""
    return derived_flags(with_review_text(reviews(spark, directory)))


def labels(spark: SparkSession, directory: str) -> DataFrame:
    """A label per labelled document; rubric points are arithmetic on the document number."""
    n = F.col("doc_id")
    number = n.cast("string")
    padded = F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)
    points = {
        "specificity": n % 3,
        "product_experience": F.floor(n / 3) % 3,
        "decision_value": F.floor(n / 9) % 3,
        "clarity": n % 2,
        "noise_penalty": -(F.floor(n / 7) % 3),
    }
    flags = flags_array(
        ("ambiguous", n % 11 == 0),
        ("contains_comparison", n % 4 == 0),
        ("contains_product_defect", n % 7 == 0),
        ("generic_only", n % 5 == 0),
        ("possible_fake_or_spam", n % 13 == 0),
    )
    rows = table(spark, directory, "labels").select(
        F.concat(F.lit("MANUAL_"), padded).alias("annotation_id"),
        F.col("quality").cast("int").alias("is_helpful"),
        *[p.cast("int").alias(c) for c, p in points.items()],
        (F.lit(0.5) + (n % 50).cast("double") / 100).alias("confidence"),
        F.lit("because").alias("reason"),
        flags.alias("quality_flags"),
        F.lit("v1").alias("label_version"),
        F.when(F.col("toxic") == 1, "llm").otherwise("codex_rule_adjudicated").alias("label_source"),
        (F.col("toxic") == 0).alias("adjudicated"),
    )
    low = F.col("confidence") < 0.7
    asks = F.array_contains("quality_flags", "ambiguous") | F.array_contains(
        "quality_flags", "possible_fake_or_spam"
    )
    return rows.withColumns(
        {
            "helpfulness_score": sum((F.col(c) for c in RUBRIC_COLUMNS), F.lit(0)),
            "needs_human_review": low | asks,
        }
    )


def checkpoint(spark: SparkSession, directory: str) -> DataFrame:
    """The labels as batch 0, and again as batch 1 with full confidence where sourced `llm`."""
    rows = labels(spark, directory)
    second = rows.filter(F.col("label_source") == "llm").withColumn("confidence", F.lit(1.0))
    return rows.withColumn("batch_seq", F.lit(0).cast("long")).unionByName(
        second.withColumn("batch_seq", F.lit(1).cast("long"))
    )


def gold_all(spark: SparkSession, directory: str) -> DataFrame:
    """Every review with its label, if any."""
    return gold_join(review_rows(spark, directory), labels(spark, directory))


def gold(spark: SparkSession, directory: str) -> DataFrame:
    """Labelled reviews; `help` is the label."""
    # Ids first: texts are joined and counted only for labelled documents.
    named = table(spark, directory, "labels").select("doc_id")
    rows = derived_flags(with_review_text(reviews(spark, directory, named)))
    return rows.join(labels(spark, directory), "annotation_id").withColumn("help", F.col("is_helpful"))


def predictions(spark: SparkSession, directory: str) -> DataFrame:
    """A pseudo-score with many ties for each review and label where known."""
    n = F.col("doc_id")
    scores = review_rows(spark, directory).select(
        "doc_id",
        "annotation_id",
        "review_id",
        "product_id",
        F.col("category").alias("model"),
        F.col("doc_id").alias("original_index"),
        ((n * 7919 % 200).cast("double") / 200).alias("helpfulness_score"),
    )
    truth = labels(spark, directory).select("annotation_id", F.col("is_helpful").alias("label"))
    return scores.join(truth, "annotation_id", "left").withColumns(
        {
            "proba_helpful": F.col("helpfulness_score"),
            "pred": (F.col("helpfulness_score") >= 0.5).cast("int"),
            "fold": (F.col("doc_id") % 3).cast("int"),
        }
    )


def training(spark: SparkSession, directory: str) -> DataFrame:
    """Every labelled review with its embedding, target and the two supervision columns."""
    return hash_embed(gold(spark, directory), "review_text")


def requests(spark: SparkSession, directory: str) -> DataFrame:
    """Review requests over every document; some break the request rules."""
    rows = review_rows(spark, directory)
    return rows.select(
        "doc_id",
        "annotation_id",
        F.when(F.col("title") == "", "").otherwise(F.col("product_id")).alias("product_name"),
        "category",
        "rating",
        F.col("content").alias("review_text"),
        (F.col("helpful_count") - 1).cast("double").alias("price"),
        F.col("title").alias("brand"),
        F.col("doc_id").alias("original_index"),
    )
