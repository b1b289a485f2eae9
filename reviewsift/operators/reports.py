"""Aggregate reports.

Every report takes a reviewed table and returns a small DataFrame. Group keys that are NULL
are left out unless stated otherwise. All group-bys combine partial results before the
shuffle; medians and percentiles come from counted values (:mod:`operators.stats`).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from reviewsift.functions.columns import (
    bool_int, bucketize, percentage, round_even, strip, text_or_empty,
)
from reviewsift.functions.text import clean_cloud_text, encoder_ready
from reviewsift.lexicon import STOP_WORDS
from reviewsift.operators.ranking import top_k
from reviewsift.operators.sketches import quantile_sketch
from reviewsift.operators.stats import (
    correlations, exact_percentiles, percentiles_of, value_levels,
)
from reviewsift.schemas import EDA_DROPPED, LABEL_NAMES, RUBRIC_COLUMNS, WEEKDAYS
from reviewsift.session import materialize

# ---------------------------------------------------------------------------
# Report buckets.
# ---------------------------------------------------------------------------
LENGTH_EDGES = (-1, 5, 10, 20, 50, math.inf)
LENGTH_LABELS = ("1-5", "6-10", "11-20", "21-50", "51+")
FINE_LENGTH_EDGES = (-1, 5, 10, 20, 40, 80, math.inf)
FINE_LENGTH_LABELS = ("1-5", "6-10", "11-20", "21-40", "41-80", ">80")
CONFIDENCE_EDGES = (0.0, 0.7, 0.8, 0.9, 1.000001)
CONFIDENCE_LABELS = ("<0.70", "0.70-0.79", "0.80-0.89", "0.90-1.00")
VOTE_EDGES = (-1, 0, 1, 2, 5, 10, math.inf)
VOTE_LABELS = ("0", "1", "2", "3-5", "6-10", ">10")
PURCHASE_NAMES = {0: "Không xác minh", 1: "Đã mua"}
DESCRIBE_PERCENTILES = {
    "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99,
}
GOLD_NUMERIC = (
    "rating", "purchased_int", "word_count", "is_helpful", "helpfulness_score", "confidence",
    *RUBRIC_COLUMNS,
)
WORD_LIMIT = 180

Means = Mapping[str, tuple[str, int]]


def _names(column: str, names: Mapping[int, str]) -> Column:
    pairs = list(names.items())
    result = F.when(F.col(column) == pairs[0][0], pairs[0][1])
    for value, name in pairs[1:]:
        result = result.when(F.col(column) == value, name)
    return result


def _share(count: str = "review_count") -> Column:
    """Percentage of the total over a report's few rows."""
    return percentage(F.col(count) / F.sum(count).over(W.partitionBy()))


def exact_mean(df: DataFrame, column: str) -> Column:
    """Mean that does not hang on the order of summation: fractions are summed as decimals (ten
    places), so that a mean on a rounding tie falls to the same side in every plan."""
    if dict(df.dtypes).get(column) not in ("double", "float"):
        return F.avg(column)
    value = F.col(column).try_cast("decimal(38,10)")
    return F.sum(value).cast("double") / F.nullif(F.count(value), F.lit(0))


def rate_aggs(label: str) -> list[Column]:
    return [
        F.count("*").alias("review_count"),
        F.sum(label).alias("helpful_count"),
        F.avg(label).alias("_rate"),
    ]


def rate_report(
    df: DataFrame,
    by: str,
    label: str = "help",
    means: Means | None = None,
    share: bool = False,
    keep_null: bool = False,
) -> DataFrame:
    """Group size, helpful sum, helpful rate in percent, other rounded means, and share."""
    means = means or {}
    grouped = df.groupBy(by).agg(
        *rate_aggs(label), *[exact_mean(df, c).alias(f"_m_{out}") for out, (c, _) in means.items()]
    )
    columns = [
        F.col(by),
        F.col("review_count"),
        F.col("helpful_count"),
        percentage(F.col("_rate")).alias("helpful_rate"),
        *[round_even(F.col(f"_m_{out}"), d).alias(out) for out, (_, d) in means.items()],
    ]
    if share:
        # Of all rows, also those whose key is NULL.
        columns.append(_share().alias("percentage"))
    report = grouped.select(*columns)
    return report if keep_null else report.filter(F.col(by).isNotNull())


def bucket_table(spark: SparkSession, column: str, labels: Sequence[str]) -> DataFrame:
    """The fixed buckets as an inline table."""
    rows = ", ".join(f"({i}, '{label}')" for i, label in enumerate(labels))
    return spark.sql(f"select * from values {rows} as t(bucket_order, {column})")


def keep_all_buckets(
    report: DataFrame, column: str, labels: Sequence[str], counts: Sequence[str]
) -> DataFrame:
    """Add empty buckets with zero counts and NULL means, in bucket order."""
    buckets = bucket_table(report.sparkSession, column, labels)
    # The report has one row per bucket, so broadcasting it is bounded.
    filled = buckets.join(F.broadcast(report), column, "left")
    return filled.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in counts}
    )


def labeling_report(gold: DataFrame) -> DataFrame:
    """G1: the labelling run in long form, `(section, key, value)`.

    Sections: totals, label_distribution, helpful_rate_by_rating,
    helpful_rate_by_sample_group, source_distribution.
    """
    keys = ["is_helpful", "rating", "sample_group", "label_source"]
    labeled = F.col("is_helpful").isNotNull()
    binary = labeled & F.col("original_manual_label").isin("0", "1")
    queue = labeled & F.coalesce(F.col("needs_human_review"), F.lit(False))
    # One pass over the gold table; every section is a roll-up of these few groups.
    groups = materialize(
        gold.groupBy(*keys).agg(
            F.count("*").alias("n"),
            F.count_if(queue).alias("queue"),
            F.sum(F.when(labeled, F.col("confidence"))).alias("conf"),
            F.count(F.when(labeled, F.col("confidence"))).alias("conf_n"),
            F.count_if(binary & F.col("agrees_with_original")).alias("agree"),
            F.count_if(binary).alias("binary"),
        )
    )
    helpful = F.sum(F.col("is_helpful") * F.col("n"))
    rate = round_even(helpful / F.sum(F.when(labeled, F.col("n"))), 4)
    rows = F.coalesce(F.sum("n"), F.lit(0))
    labeled_rows = F.coalesce(F.sum(F.when(labeled, F.col("n"))), F.lit(0))
    totals = groups.agg(
        rows.alias("total_source_rows"),
        labeled_rows.alias("labeled_rows"),
        (rows - labeled_rows).alias("unlabeled_rows"),
        rate.alias("helpful_rate"),
        F.coalesce(F.sum("queue"), F.lit(0)).alias("human_review_queue_rows"),
        round_even(F.sum("conf") / F.nullif(F.sum("conf_n"), F.lit(0)), 4).alias("mean_confidence"),
        round_even(F.sum("agree") / F.nullif(F.sum("binary"), F.lit(0)), 4).alias(
            "agreement_with_original_binary_labels"
        ),
    )
    names = totals.columns
    long_totals = totals.select(
        *[F.col(n).cast("double").alias(n) for n in names]
    ).unpivot([], names, "key", "value")

    def section(name: str, key: str, value: Column) -> DataFrame:
        part = groups.filter(labeled & F.col(key).isNotNull()).groupBy(key).agg(value.alias("value"))
        return part.select(
            F.lit(name).alias("section"),
            F.col(key).cast("string").alias("key"),
            F.col("value").cast("double").alias("value"),
        )

    report = long_totals.select(F.lit("totals").alias("section"), "key", "value")
    for part in (
        section("label_distribution", "is_helpful", F.sum("n")),
        section("helpful_rate_by_rating", "rating", rate),
        section("helpful_rate_by_sample_group", "sample_group", rate),
        section("source_distribution", "label_source", F.sum("n")),
    ):
        report = report.unionByName(part)
    return report


def label_distribution(df: DataFrame, label: str = "help") -> DataFrame:
    """Rows per label with name and percentage."""
    counts = df.groupBy(label).agg(F.count("*").alias("count"))
    return counts.select(
        label, _names(label, LABEL_NAMES).alias("label"), "count", _share("count").alias("percentage")
    ).filter(F.col(label).isNotNull())


RATING_MEANS: Means = {
    "avg_score": ("helpfulness_score", 2),
    "avg_confidence": ("confidence", 2),
    "avg_word_count": ("word_count", 2),
}


def by_rating(
    df: DataFrame, label: str = "help", means: Means = RATING_MEANS, keep_null: bool = False
) -> DataFrame:
    """Helpful rate and means by rating; ``keep_null`` keeps missing ratings as a group."""
    return rate_report(df, "rating", label, means, keep_null=keep_null)


def _by_bucket(
    df: DataFrame,
    bucket: Column,
    column: str,
    labels: Sequence[str],
    label: str,
    means: Means,
    share: bool = False,
) -> DataFrame:
    # Rows outside every bucket get a blank, never NULL: a "key is not NULL" test would be
    # pushed below the grouping and evaluate the bucket expression once more per branch.
    keyed = df.withColumn(column, F.coalesce(bucket, F.lit("")))
    report = rate_report(keyed, column, label, means, share, keep_null=True)
    counts = ["review_count", "helpful_count"] + (["percentage"] if share else [])
    return keep_all_buckets(report, column, labels, counts)


def by_length(
    df: DataFrame,
    label: str = "help",
    length: str = "word_count",
    fine: bool = False,
    means: Means | None = None,
) -> DataFrame:
    """By word-count bucket (5 bins, or 6 with ``fine``), empty buckets kept."""
    edges, labels = (
        (FINE_LENGTH_EDGES, FINE_LENGTH_LABELS) if fine else (LENGTH_EDGES, LENGTH_LABELS)
    )
    if means is None:
        means = {} if fine else {k: RATING_MEANS[k] for k in ("avg_score", "avg_confidence")}
    return _by_bucket(
        df, bucketize(length, edges, labels), "length_bucket", labels, label, means
    )


def by_sample_group(df: DataFrame, label: str = "help") -> DataFrame:
    """By sample group, largest first."""
    return rate_report(df, "sample_group", label, RATING_MEANS).orderBy(
        F.desc("review_count"), "sample_group"
    )


def by_score(df: DataFrame, label: str = "help") -> DataFrame:
    """By rubric score with its share of all rows."""
    return rate_report(
        df, "helpfulness_score", label, {"avg_confidence": ("confidence", 3)}, share=True
    )


def by_confidence(df: DataFrame, label: str = "help") -> DataFrame:
    """By confidence bucket (left-closed), empty buckets kept, others excluded."""
    bucket = bucketize("confidence", CONFIDENCE_EDGES, CONFIDENCE_LABELS, right=False)
    means = {"avg_score": ("helpfulness_score", 2)}
    return _by_bucket(df, bucket, "confidence_bucket", CONFIDENCE_LABELS, label, means, share=True)


def by_source(df: DataFrame, label: str = "help") -> DataFrame:
    """By label source with share."""
    return rate_report(df, "label_source", label, RATING_MEANS, share=True)


def by_purchase(df: DataFrame, label: str = "help") -> DataFrame:
    """By purchase flag with a readable status."""
    means = {k: RATING_MEANS[k] for k in ("avg_score", "avg_word_count")}
    report = rate_report(df, "purchased_int", label, means)
    return report.withColumn("purchase_status", _names("purchased_int", PURCHASE_NAMES))


def rubric_by_label(df: DataFrame, label: str = "help") -> DataFrame:
    """Mean rubric points by label, one row per criterion."""
    means = (
        df.filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg(*[round_even(F.avg(c), 3).alias(c) for c in RUBRIC_COLUMNS])
    )
    return means.unpivot([label], list(RUBRIC_COLUMNS), "criterion", "average_score").withColumn(
        "label", _names(label, LABEL_NAMES)
    )


def flag_summary(df: DataFrame, label: str = "help", flags: str = "quality_flags") -> DataFrame:
    """Occurrences and helpful rate per flag, largest first.

    ``flags`` may be an array or JSON text; empty or unreadable values count as `no_flag`.
    """
    value = F.col(flags)
    if dict(df.dtypes)[flags] == "string":
        value = F.try_variant_get(F.try_parse_json(value), "$", "array<string>")
    listed = F.when(F.size(value) > 0, value).otherwise(F.array(F.lit("no_flag")))
    return (
        df.select(label, F.explode(listed).alias("flag"))
        .filter(F.col("flag").isNotNull())
        .groupBy("flag")
        .agg(
            F.count("*").alias("occurrence_count"),
            F.sum(label).alias("helpful_count"),
            percentage(F.avg(label)).alias("helpful_rate"),
        )
        .orderBy(F.desc("occurrence_count"), "flag")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] = GOLD_NUMERIC) -> DataFrame:
    """Pearson correlation matrix rounded to 3 digits."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i:]]
    one, value = correlations(df, pairs)
    # Each value once, then laid out in both triangles.
    flat = one.selectExpr(
        *[f"rint({value[pair]} * 1e3) / 1e3 as p{k}" for k, pair in enumerate(pairs)]
    )
    at = {pair: k for k, pair in enumerate(pairs)}
    rows = [
        f"named_struct('variable', '{x}', "
        + ", ".join(f"'{y}', p{at[(x, y)] if (x, y) in at else at[(y, x)]}" for y in columns)
        + ")"
        for x in columns
    ]
    return flat.selectExpr(f"inline(array({', '.join(rows)}))")


def target_correlation(
    df: DataFrame, target: str, columns: Sequence[str], digits: int = 6
) -> DataFrame:
    """Correlation of each column with the target, strongest first."""
    others = [c for c in columns if c != target]
    one, value = correlations(df, [(c, target) for c in others])
    scale = f"1e{digits}"
    rows = [
        f"named_struct('variable', '{c}', 'correlation', "
        f"rint({value[(c, target)]} * {scale}) / {scale})"
        for c in others
    ]
    return one.selectExpr(f"inline(array({', '.join(rows)}))").orderBy(
        F.desc_nulls_last(F.abs("correlation")), "variable"
    )


def _narrow(df: DataFrame, *columns: str) -> DataFrame:
    """The columns of a report, written once when it needs several passes: values derived
    from texts are then computed a single time."""
    return materialize(df.select(*dict.fromkeys(columns)))


def _with_percentiles(
    report: DataFrame, df: DataFrame, by: str, picks: Mapping[str, tuple[str, int]], p: float = 0.5
) -> DataFrame:
    """Join exact percentiles of some columns to a report by group."""
    columns = sorted({c for c, _ in picks.values()})
    wide = (
        exact_percentiles(df, columns, {"p": p}, [by])
        .groupBy(by)
        .agg(*[F.max(F.when(F.col("column") == c, F.col("p"))).alias(f"_p_{c}") for c in columns])
        .withColumnRenamed(by, "_by")
    )
    joined = report.join(wide, F.col(by).eqNullSafe(F.col("_by")), "left")
    return joined.withColumns(
        {out: round_even(F.col(f"_p_{c}"), d) for out, (c, d) in picks.items()}
    ).drop("_by", *[f"_p_{c}" for c in columns])


def label_profile(df: DataFrame, label: str = "help", approx: bool = False) -> DataFrame:
    """Averages and median length per label, with the verified-purchase rate.

    ``approx`` takes the median from a sketch in the same pass (see :mod:`operators.sketches`).
    """
    means = {
        "avg_rating": "rating",
        "avg_word_count": "word_count",
        "avg_score": "helpfulness_score",
        "avg_confidence": "confidence",
    }
    df = df.filter(F.col(label).isNotNull())
    if not approx:
        df = _narrow(df, label, "purchased_int", *means.values())
    median = F.when(F.count("word_count") > 0, F.kll_sketch_get_quantile_double(quantile_sketch("word_count"), F.lit(0.5)))
    report = df.groupBy(label).agg(
        F.count("*").alias("review_count"),
        *[round_even(F.avg(c), 3).alias(out) for out, c in means.items()],
        # Rounded as a rate first, then shown in percent, as in the published report.
        percentage(round_even(F.avg("purchased_int"), 3)).alias("verified_purchase_rate"),
        *([round_even(median, 3).alias("median_word_count")] if approx else []),
    )
    if approx:
        return report.withColumn("label", _names(label, LABEL_NAMES))
    report = _with_percentiles(report, df, label, {"median_word_count": ("word_count", 3)})
    return report.withColumn("label", _names(label, LABEL_NAMES))


def _duplicates(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows beyond the first per value, from a count per 128-bit digest; NULLs are equal."""
    digest = F.md5(F.coalesce(F.concat(F.lit("v"), F.col(column).cast("string")), F.lit("n")))
    return df.groupBy(digest.alias("_d")).agg(F.count("*").alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias(name)
    )


def summary(df: DataFrame, label: str = "help") -> DataFrame:
    """One row of counts, rates and averages."""
    width, removed = len(df.columns), [c for c in EDA_DROPPED if c not in df.columns]
    df = _narrow(
        df.withColumn("content", F.when(F.col("content").isNotNull(), "")),
        "annotation_id", "review_id", "content", label, "rating", "word_count",
        "helpfulness_score", "confidence", "purchased_int",
    )
    report = df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("content").isNull()).alias("missing_content"),
        F.coalesce(F.sum(label), F.lit(0)).alias("helpful_count"),
        F.count_if(F.col(label) == 0).alias("not_helpful_count"),
        percentage(F.avg(label)).alias("helpful_rate"),
        round_even(F.avg("rating"), 2).alias("average_rating"),
        round_even(F.avg("word_count"), 2).alias("average_word_count"),
        round_even(F.avg("helpfulness_score"), 2).alias("average_score"),
        round_even(F.avg("confidence"), 3).alias("average_confidence"),
        percentage(F.avg("purchased_int")).alias("verified_purchase_rate"),
    )
    median = exact_percentiles(df, ["word_count"], {"p": 0.5})
    return report.withColumns(
        {
            "columns": F.lit(width),
            "duplicate_annotation_ids": _duplicates(df, "annotation_id", "d").scalar(),
            "duplicate_review_ids": _duplicates(df, "review_id", "d").scalar(),
            "median_word_count": round_even(median.select("p").scalar(), 2),
            "removed_columns": F.array(*[F.lit(c) for c in removed]).cast("array<string>"),
        }
    )


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, most first (one pass)."""
    columns = list(columns or df.columns)
    one = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return one.unpivot(["_rows"], columns, "column", "missing_count").select(
        "column",
        "missing_count",
        percentage(F.col("missing_count") / F.nullif(F.col("_rows"), F.lit(0))).alias(
            "missing_rate_pct"
        ),
    ).orderBy(F.desc("missing_count"), "column")


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Type, missing count, missing rate and distinct values per column.

    Exact distinct counts come from one long table of (column, digest) that is combined
    before the shuffle; ``approx`` uses a sketch in a single pass instead.
    """
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    missing = missing_report(df)
    if approx:
        one = df.agg(*[F.approx_count_distinct(c).alias(c) for c in df.columns])
        unique = one.unpivot([], df.columns, "column", "unique_count")
    else:
        values = F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.md5(F.col(c).cast("string")).alias("digest"))
                for c in df.columns
            ]
        )
        unique = (
            df.select(F.explode(values).alias("_v"))
            .select("_v.*")
            .filter(F.col("digest").isNotNull())
            .groupBy("column", "digest")
            .agg(F.lit(1).alias("_one"))
            .groupBy("column")
            .agg(F.count("*").alias("unique_count"))
        )
    return missing.join(unique, "column", "left").select(
        "column",
        F.element_at(types, F.col("column")).alias("dtype"),
        "missing_count",
        "missing_rate_pct",
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
    )


METADATA_COLUMNS = ("product_name", "category", "helpful_count", "created_at")


def metadata_missing(df: DataFrame, columns: Sequence[str] = METADATA_COLUMNS) -> DataFrame:
    """Empty or missing metadata per column."""
    one = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(strip(text_or_empty(c)) == "").alias(c) for c in columns],
    )
    return one.unpivot(["_rows"], list(columns), "column", "empty_or_missing_count").select(
        "column",
        "empty_or_missing_count",
        (F.col("_rows") - F.col("empty_or_missing_count")).alias("non_empty_count"),
        percentage(
            F.col("empty_or_missing_count") / F.nullif(F.col("_rows"), F.lit(0))
        ).alias("empty_or_missing_rate_pct"),
    )


def quality_counters(
    df: DataFrame, text: str = "review_context", label: str = "help", key: str = "review_id"
) -> DataFrame:
    """Duplicate ids, duplicate texts, empty texts and labels outside 0/1."""
    known = F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    # One pass over the texts; what follows reads their digests.
    rows = materialize(
        df.select(
            F.col(key).alias("key"), F.sha2(F.col(text), 256).alias("text"),
            (F.col(text) == "").alias("empty"), known.alias("known"),
        )
    )
    return rows.agg(
        F.count_if("empty").alias("empty_text"), F.count_if(~F.col("known")).alias("label_outside_01")
    ).withColumns(
        {
            "duplicate_id": _duplicates(rows, "key", "d").scalar(),
            "duplicate_text": _duplicates(rows, "text", "d").scalar(),
        }
    )


def overview(df: DataFrame, approx: bool = False) -> DataFrame:
    """Rows, date range, and distinct products and users."""
    if not approx:
        df = materialize(df.select("created_at", *_DISTINCT))  # read once for three aggregates
    base = df.agg(
        F.count("*").alias("rows"),
        F.min("created_at").alias("first_created_at"),
        F.max("created_at").alias("last_created_at"),
        *(
            [F.approx_count_distinct(c).alias(n) for c, n in _DISTINCT.items()] if approx else []
        ),
    )
    if approx:
        return base
    return base.withColumns(
        {
            n: df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.lit(1)).agg(F.count("*")).scalar()
            for c, n in _DISTINCT.items()
        }
    )


_DISTINCT = {"product_id": "products", "user_id": "users"}


def describe(
    df: DataFrame,
    columns: Sequence[str],
    percentiles: Mapping[str, float] = DESCRIBE_PERCENTILES,
    digits: int = 6,
) -> DataFrame:
    """Count, mean, sample deviation, min, max and percentiles, one row per column."""
    levels = value_levels(df, columns)
    means = levels.groupBy("column").agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("_mean")
    )
    off = F.col("value") - F.col("_mean")
    # One row per column, so broadcasting the means is bounded.
    stats = levels.join(F.broadcast(means), "column").groupBy("column").agg(
        F.sum("n").alias("count"),
        round_even(F.first("_mean"), digits).alias("mean"),
        round_even(
            F.sqrt(F.sum(off * off * F.col("n")) / F.nullif(F.sum("n") - 1, F.lit(0))), digits
        ).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    exact = percentiles_of(levels, dict(percentiles))
    return stats.join(
        exact.select("column", *[round_even(F.col(p), digits).alias(p) for p in percentiles]),
        "column",
    )


def length_by_label(
    df: DataFrame,
    label: str = "help",
    words: str = "review_word_length",
    chars: str = "review_char_length",
    sentences: str | None = "sentence_count",
) -> DataFrame:
    """Average and median length per label."""
    means = {"avg_word_count": words, "avg_char_len": chars}
    if sentences:
        means["avg_sentence_count"] = sentences
    df = _narrow(df.filter(F.col(label).isNotNull()), label, *means.values())
    report = df.groupBy(label).agg(
        F.count("*").alias("review_count"),
        *[round_even(F.avg(c), 2).alias(out) for out, c in means.items()],
    )
    return _with_percentiles(
        report, df, label, {"median_word_count": (words, 2), "median_char_len": (chars, 2)}
    )


def by_votes(df: DataFrame, label: str = "help", buckets: bool = False) -> DataFrame:
    """By presence of platform votes, or by vote bucket with empty buckets kept."""
    if buckets:
        bucket = bucketize("helpful_count", VOTE_EDGES, VOTE_LABELS)
        return _by_bucket(df, bucket, "vote_bucket", VOTE_LABELS, label, {})
    return df.groupBy("has_helpful_vote").agg(
        F.count("*").alias("review_count"),
        round_even(F.avg("helpful_count"), 3).alias("avg_platform_helpful_count"),
        F.sum(label).alias("labeled_helpful_count"),
        round_even(F.avg(label), 3).alias("labeled_helpful_rate"),
    )


def by_year(df: DataFrame, label: str = "help", words: str = "review_word_length") -> DataFrame:
    """Yearly trend; rows without a date are left out."""
    return rate_report(df, "created_year", label, {"avg_word_length": (words, 6)})


def by_weekday(df: DataFrame, label: str = "help") -> DataFrame:
    """Monday to Sunday, missing days kept."""
    report = rate_report(df, "created_weekday", label)
    return keep_all_buckets(
        report, "created_weekday", WEEKDAYS, ["review_count", "helpful_count"]
    )


def rating_crosstab(df: DataFrame, label: str = "help") -> DataFrame:
    """Share of each label within a rating, in percent."""
    rows = df.filter(F.col("rating").isNotNull() & F.col(label).isNotNull())
    return rows.groupBy("rating").agg(
        *[
            round_even(F.count_if(F.col(label) == v) * 100.0 / F.count("*"), 6).alias(
                f"{label}_{v}_pct"
            )
            for v in LABEL_NAMES
        ]
    )


def two_way_counts(df: DataFrame, a: str, b: str | None = None) -> DataFrame:
    """Rows per pair of values (or per value), NULL included."""
    keys = [a] if b is None else [a, b]
    return df.groupBy(*keys).agg(F.count("*").alias("count"))


def normalisation_impact(
    df: DataFrame, text: str = "review_text", label: str = "help"
) -> DataFrame:
    """What the encoder-ready cleaning changes, and average words by label."""
    ready = encoder_ready(df, text)
    changed = F.col("encoder_text") != text_or_empty(text)
    return ready.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("encoder_text") == "").alias("empty_after_clean"),
        F.count_if(changed).alias("rows_changed"),
        *[
            round_even(F.avg(F.when(F.col(label) == v, F.col("encoder_word_count"))), 2).alias(
                f"avg_words_label_{v}"
            )
            for v in LABEL_NAMES
        ],
    )


def histogram(
    df: DataFrame,
    column: str,
    bins: int = 60,
    by: Sequence[str] = (),
    clip_percentile: float | None = None,
) -> DataFrame:
    """Fixed-width bins between the minimum and maximum; the last bin is closed.

    Rows are counted per value first; the clip limit, the range and the bins all come from
    that table.
    """
    levels = value_levels(df, [column], by)
    clipped = _clipped(levels, clip_percentile)
    low, high = (clipped.agg(f("value")).scalar() for f in (F.min, F.max))
    ranged = clipped.withColumns({"_low": low, "_high": high})
    width = (F.col("_high") - F.col("_low")) / bins
    number = F.when(
        width > 0, F.least(F.floor((F.col("value") - F.col("_low")) / width), F.lit(bins - 1))
    ).otherwise(0)
    return (
        ranged.withColumns({"bin": number.cast("int"), "_width": width})
        .groupBy(*by, "bin")
        .agg(
            F.sum("n").alias("count"),
            round_even(F.min(F.col("_low") + F.col("bin") * F.col("_width")), 6).alias("bin_start"),
            round_even(F.min(F.col("_low") + (F.col("bin") + 1) * F.col("_width")), 6).alias(
                "bin_end"
            ),
        )
    )


def _clipped(levels: DataFrame, percentile: float | None) -> DataFrame:
    """Value levels of one column with values above a percentile of all rows set to it."""
    if percentile is None:
        return levels
    every = materialize(levels.groupBy("column", "value").agg(F.sum("n").alias("n")))
    limit = percentiles_of(every, {"p": percentile}).select("p").scalar()
    return levels.withColumn("value", F.least("value", limit))


def box_stats(
    df: DataFrame, column: str, by: str = "help", clip_percentile: float | None = 0.99
) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count per group, after clipping."""
    counted = _clipped(
        value_levels(df.filter(F.col(by).isNotNull()), [column], [by]), clip_percentile
    )
    levels = materialize(counted.groupBy(by, "column", "value").agg(F.sum("n").alias("n")))
    quartiles = percentiles_of(levels, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [by]).drop("column")
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("value").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return (
        levels.join(quartiles, by)
        .groupBy(by, "q1", "median", "q3")
        .agg(
            F.sum("n").alias("count"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
        )
    )


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows with equal labels; a missing label counts as disagreement."""
    return df.agg(
        F.count("*").alias("rows"),
        round_even(F.avg(bool_int(F.col(a) == F.col(b))), 6).alias("agreement"),
    )


def rule_accuracy(
    df: DataFrame, label: str = "help", score: str = "helpfulness_score"
) -> DataFrame:
    """Accuracy of the score rule outside the borderline band 2..3."""
    known = df.filter(~F.col(score).between(2, 3))
    right = bool_int((F.col(score) >= 4).cast("int") == F.col(label))
    return known.agg(
        F.count("*").alias("rows"), round_even(F.avg(right), 6).alias("rule_accuracy")
    )


def word_frequencies(
    df: DataFrame,
    text: str = "review_context",
    label: str = "help",
    stop_words: Sequence[str] = STOP_WORDS,
    limit: int = WORD_LIMIT,
) -> DataFrame:
    """The most frequent words per label, number-only tokens left out.

    Words are counted per (label, word) before the ranking, and each task keeps only its own
    best words, so a label with most of the rows is never gathered.
    """
    words = (
        df.filter(F.col(label).isNotNull())
        .select(label, F.explode(F.split(clean_cloud_text(text), " ")).alias("word"))
        .filter((F.col("word") != "") & ~F.col("word").rlike(r"^\p{Nd}+$"))
        .filter(~F.col("word").isin(list(stop_words)))
    )
    counts = words.groupBy(label, "word").agg(F.count("*").alias("count"))
    return top_k(counts, [label], [F.desc("count"), F.col("word")], limit)


def run_summary(df: DataFrame, label: str = "candidate_llm_is_helpful") -> DataFrame:
    """Helpful rate and rows per label of a labelling run."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("count"))
    everything = W.partitionBy()
    rate = F.sum(F.col(label) * F.col("count")).over(everything) / F.sum("count").over(everything)
    return counts.withColumn("helpful_rate", round_even(rate, 6))

