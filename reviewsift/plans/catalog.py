"""Every registered query with its SQL counterpart.

Each query reads the supplied tables whole. Arrays and maps are shown as text so that results
can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import StreamingQueryException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewsift.functions.columns import round_even
from reviewsift.functions.features import (
    derived_flags, eda_features, metadata_features, reason_codes, sample_weight,
)
from reviewsift.functions.text import (
    canonical_ids, clean_cloud_text, clean_corpus, encoder_ready, nfc_corpus, with_review_text,
)
from reviewsift.messages import EXPLANATION
from reviewsift.models import embed, moments, stack
from reviewsift.operators import explain, gold as joins, metrics, ranking, reports, responses
from reviewsift.operators import rubric, rubric_v2, sketches, validate
from reviewsift.plans import flows, oracle as o, views as v
from reviewsift.schemas import (
    LABEL_COLUMNS, METADATA_FEATURES, OUTPUT_FIELDS, RAW_REVIEWS, RUBRIC_COLUMNS, TASK_COLUMNS,
)
from reviewsift.session import materialize, shared_dir
from reviewsift.sources import io
from reviewsift.sources.manifest import manifest
from reviewsift.streaming import checkpointing
from reviewsift.streaming.scoring import batch_files, read_review_stream, score_rows, score_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/reviewsift/{name}-{uuid.uuid4().hex}"


def _text(column: str) -> F.Column:
    return F.array_join(column, ",").alias(column)


# --- S: sources and sinks ----------------------------------------------------------

RAW = ["review_id", "product_id", "user_id", "rating", "title", "content", "helpful_count", "purchased"]


@query(
    "s1_csv_reviews",
    o.sql("reviews", f"""select review_id, product_id, user_id, rating,
      nullif(title, '') as title, nullif(content, '') as content, helpful_count, purchased
      from review_rows"""),
)
def s1(spark, d):
    path = _scratch(spark, "csv")
    io.write_table(v.reviews(spark, d).select(*RAW_REVIEWS.names), path, "csv")
    rows = io.read_reviews(spark, path, fmt="csv").select(*RAW)
    return rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("title", "content")})


@query(
    "s2_batch_directory",
    o.sql("reviews", """select source_file, cast(count(*) as bigint) as n,
      cast(sum(length(content)) as bigint) as chars, true as named from review_rows group by source_file"""),
)
def s2(spark, d):
    path = _scratch(spark, "batches")
    rows = v.reviews(spark, d).withColumn("batch", F.col("product_id"))
    rows.select("annotation_id", "content", "batch").write.partitionBy("batch").parquet(path)
    scan = io.read_batches(spark, path, fmt="parquet")
    # File names are arbitrary here, so the directory value stands for the file; that each row
    # carries its own file's name shows in the path of the row.
    scan = scan.withColumn("named", F.input_file_name().endswith(F.concat(F.lit("/"), "source_file")))
    return (
        scan.groupBy(F.concat("batch", F.lit(".csv")).alias("source_file"))
        .agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"), F.every("named").alias("named"))
    )


@query("s3_required_columns", o.sql("reviews", """
  select review_id, length(content) as chars, 'no_such_a,no_such_b' as missing from review_rows"""))
def s3(spark, d):
    rows = io.require_columns(v.reviews(spark, d), RAW_REVIEWS.names)
    missing = ""
    try:
        io.require_columns(rows, ["no_such_b", "review_id", "no_such_a"])
    except ValueError as error:
        missing = ",".join(n for n in ("no_such_a", "no_such_b", "review_id") if n in str(error))
    return rows.select("review_id", F.length("content").alias("chars"), F.lit(missing).alias("missing"))


@query(
    "s4_defaults",
    o.sql("reviews", f"""select annotation_id, coalesce(rating, 0) as rating, 0 as purchased_int,
      word_count, '' as product_name from review_rows"""),
)
def s4(spark, d):
    rows = v.reviews(spark, d).drop("purchased", "product_name")
    filled = io.with_defaults(rows, {**io.OPTIONAL_DEFAULTS, "product_name": ("string", "")})
    return filled.select("annotation_id", "rating", "purchased_int", "word_count", "product_name")


CHECKPOINT_SQL = """
select annotation_id, is_helpful, confidence, batch_seq from (
  select *, row_number() over (partition by annotation_id order by batch_seq desc) as rn
  from checkpoint) where rn = 1"""


@query("s5_latest_labels", o.sql("labels checkpoint", CHECKPOINT_SQL))
def s5(spark, d):
    return io.latest_labels(v.checkpoint(spark, d)).select(
        "annotation_id", "is_helpful", "confidence", F.col("batch_seq").cast("int")
    )


@query("s6_checkpoint_roundtrip", o.sql("labels checkpoint", CHECKPOINT_SQL))
def s6(spark, d):
    path = _scratch(spark, "checkpoint")
    rows = v.labels(spark, d)
    io.append_checkpoint(rows, path, 0)
    again = rows.filter(F.col("label_source") == "llm").withColumn("confidence", F.lit(1.0))
    io.append_checkpoint(again, path, 1)
    return io.read_checkpoint(spark, path).select(
        "annotation_id", "is_helpful", "confidence", F.col("batch_seq").cast("int")
    )


@query("s7_table_sink", o.sql("reviews labels gold", """
  select annotation_id, help, cast(len(quality_flags) as integer) as n_flags from gold"""))
def s7(spark, d):
    path = _scratch(spark, "table")
    io.write_table(v.gold(spark, d), path)
    return spark.read.parquet(path).select(
        "annotation_id", "help", F.size("quality_flags").alias("n_flags")
    )


@query("s8_manifest", o.sql("reviews labels gold", """
  select (select count(*) from gold) as output_rows, (select count(*) from reviews) as raw_rows,
    (select count(*) from label_rows) as label_rows,
    '0:' || (select count(*) from gold where help = 0) || ',1:' ||
      (select count(*) from gold where help = 1) as distribution,
    'review_id,product_id,user_id' as merge_keys, 'help' as target_column"""))
def s8(spark, d):
    sources = {"raw": v.reviews(spark, d), "label": v.labels(spark, d)}
    row = manifest(
        v.gold(spark, d), "help", sources, ["review_id", "product_id", "user_id"],
    )
    entries = F.transform(
        F.map_entries("target_distribution"),
        lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")),
    )
    return row.select(
        "output_rows", "raw_rows", "label_rows", F.array_join(entries, ",").alias("distribution"),
        _text("merge_keys"), "target_column",
    )


# --- P: projections, filters, validation ---------------------------------------------


@query("p1_gold_checks", o.sql("reviews labels gold", """
  select cast(count(*) as bigint) as rows, cast(count(*) - count(distinct annotation_id) as bigint) as duplicate_ids,
    cast(count(*) - count(is_helpful) as bigint) as missing_labels,
    cast(sum(case when label_source in ('llm', 'codex_rule_adjudicated') then 0 else 1 end) as bigint) as unknown_sources
  from gold_all"""))
def p1(spark, d):
    return validate.gold_checks(validate.to_gold(v.gold_all(spark, d)))


def _task_sql(prefix_labels: bool, output_prefix: str) -> str:
    cols = [f"cast({c} as {t}) as {c}" for c, t in (("rating", "integer"), ("word_count", "integer"))]
    cols += [c for c in TASK_COLUMNS if c not in ("rating", "word_count")]
    if prefix_labels:
        cols += [
            f"array_to_string({c}, ',') as reference_{c}" if c == "quality_flags" else f"{c} as reference_{c}"
            for c in LABEL_COLUMNS
        ]
    cols += [f"'' as {output_prefix}{c}" for c in OUTPUT_FIELDS]
    return f"select {', '.join(cols)} from gold"


@query("p2_labeling_task", o.sql("reviews labels gold", _task_sql(True, "candidate_llm_")))
def p2(spark, d):
    task = validate.labeling_task(v.gold(spark, d))
    return task.withColumn("reference_quality_flags", _text("reference_quality_flags"))


@query("p3_raw_labeling_task", o.sql("reviews labels gold", _task_sql(False, "llm_")))
def p3(spark, d):
    return validate.raw_labeling_task(v.gold(spark, d))


@query("p4_review_dataset", o.sql("reviews labels gold", """
  select review_id, product_id, product_name, category, rating, review_text, helpful_count,
    created_at, help from gold"""))
def p4(spark, d):
    return validate.review_dataset(v.gold(spark, d))


@query("p5_valid_unique", o.sql("reviews", """
  select product_id, annotation_id, word_count from (
    select *, row_number() over (partition by product_id order by created_at, annotation_id) as rn
    from review_rows where length(review_text) > 0) where rn = 1"""))
def p5(spark, d):
    rows = v.review_rows(spark, d).select(
        "product_id", "annotation_id", "created_at", "word_count", "review_text"
    )
    first = validate.valid_unique(rows, ["created_at", "annotation_id"], key="product_id")
    return first.select("product_id", "annotation_id", "word_count")


@query("p6_work_slice", o.sql("reviews", """
  select annotation_id, word_count from review_rows order by annotation_id limit 300 offset 100"""))
def p6(spark, d):
    rows = v.review_rows(spark, d).select("annotation_id", "word_count")
    return ranking.work_slice(rows, 100, 300, [F.col("annotation_id")])


@query("p7_coerce_types", o.sql("reviews labels gold", """
  select annotation_id, cast(rating as double) as rating, coalesce(cast(helpful_count as double), 0.0) as helpful_count,
    greatest(0.0::double, least(1.0::double, confidence * 1.5::double)) as confidence, is_helpful,
    purchased from gold"""))
def p7(spark, d):
    rows = v.gold(spark, d).withColumns(
        {
            "confidence": (F.col("confidence") * 1.5).cast("string"),
            "rating": F.col("rating").cast("string"),
            "is_helpful": F.col("is_helpful").cast("string"),
        }
    )
    return validate.coerce_types(rows).select(
        "annotation_id", "rating", "helpful_count", "confidence", "is_helpful", "purchased"
    )


@query("p8_review_queue", o.sql("reviews labels gold", """
  select annotation_id, confidence, array_to_string(quality_flags, ',') as quality_flags from gold_all
  where is_helpful is not null and needs_human_review"""))
def p8(spark, d):
    return validate.review_queue(v.gold_all(spark, d)).select(
        "annotation_id", "confidence", _text("quality_flags")
    )


@query("p9_constant_columns", o.sql("reviews", """
  select 'product_name' as "column", count(distinct product_name) <= 1 as is_constant from review_rows
  union all select 'rating', count(distinct rating) + count(distinct case when rating is null then 0 end) <= 1 from review_rows
  union all select 'word_count', count(distinct word_count) <= 1 from review_rows
  union all select 'purchased_int', count(distinct purchased_int) <= 1 from review_rows"""))
def p9(spark, d):
    rows = v.review_rows(spark, d)
    return validate.constant_columns(
        rows, ["product_name", "rating", "word_count", "purchased_int"]
    )


@query("p10_request_errors", o.sql("reviews requests", f"""
  select annotation_id, array_to_string({o.flag_list(
      ('product_name', 'length(product_name) not between 1 and 200'),
      ('category', 'length(category) not between 1 and 100'),
      ('rating', 'coalesce(rating not between 1 and 5, true)'),
      ('review_text', 'length(review_text) not between 1 and 10000'),
      ('blank_text', f"length(review_text) > 0 and {o.strip('review_text')} = ''"),
      ('price', 'price < 0'), ('brand', 'length(brand) > 100'))}, ',') as errors
  from requests"""))
def p10(spark, d):
    return validate.with_errors(v.requests(spark, d)).select("annotation_id", _text("errors"))


@query("p11_eda_view", o.sql("reviews labels gold", """
  select annotation_id, help, confidence, label_source from gold"""))
def p11(spark, d):
    return validate.eda_view(v.gold(spark, d)).select(
        "annotation_id", "help", "confidence", "label_source"
    )


# --- J: joins ----------------------------------------------------------------------------


def _keyed_labels(spark, d):
    keys = v.reviews(spark, d).select(
        "annotation_id", "sample_group", "review_id", "product_id", "user_id"
    )
    return keys.join(v.labels(spark, d), "annotation_id")


@query("j1_full_labeled", o.sql("reviews labels gold", """
  select review_id, product_id, user_id, rating, title, content, review_text, created_at,
    helpful_count, purchased, purchased_int, crawled_at, word_count, annotation_id, sample_group,
    help, helpfulness_score, confidence, reason, specificity, product_experience, decision_value,
    clarity, noise_penalty, array_to_string(quality_flags, ',') as quality_flags, label_version,
    label_source, adjudicated, needs_human_review
  from gold"""))
def j1(spark, d):
    raw = v.reviews(spark, d).drop("annotation_id", "sample_group")
    full = joins.full_labeled(raw, _keyed_labels(spark, d))
    return full.withColumn("quality_flags", _text("quality_flags"))


@query("j2_missing_keys", o.sql("reviews labels", """
  select review_id, product_id, user_id from review_rows r
  where not exists (select 1 from label_rows l where l.annotation_id = r.annotation_id)
  order by review_id, product_id, user_id limit 10"""))
def j2(spark, d):
    return joins.missing_keys(v.reviews(spark, d), _keyed_labels(spark, d))


@query("j3_gold_join", o.sql("reviews labels gold", """
  select annotation_id, is_helpful, confidence, array_to_string(quality_flags, ',') as quality_flags,
    original_manual_label, agrees_with_original from gold_all"""))
def j3(spark, d):
    return v.gold_all(spark, d).select(
        "annotation_id", "is_helpful", "confidence", _text("quality_flags"),
        "original_manual_label", "agrees_with_original",
    )


@query("j4_pending", o.sql("reviews labels checkpoint", """
  select annotation_id from review_rows where annotation_id not in (select annotation_id from checkpoint)"""))
def j4(spark, d):
    return joins.pending(v.reviews(spark, d), v.checkpoint(spark, d)).select("annotation_id")


def _batches(spark, d):
    """Requests by product, and answers that lack unlabelled rows and add foreign ones."""
    rows = v.reviews(spark, d).withColumn("batch_id", F.col("product_id"))
    asked = rows.select("batch_id", "annotation_id")
    given = joins.pending(rows, v.labels(spark, d)).select(
        F.when(F.col("rating") == 5, "src0").otherwise(F.col("batch_id")).alias("batch_id"),
        "annotation_id",
    )
    return asked, given


BATCHES_SQL = """,
asked as (select product_id as batch_id, annotation_id from review_rows),
given as (select case when rating = 5 then 'src0' else product_id end as batch_id, annotation_id
          from review_rows where annotation_id not in (select annotation_id from label_rows)),
both_ as (select coalesce(a.batch_id, g.batch_id) as batch_id, coalesce(a.annotation_id, g.annotation_id) as annotation_id,
            a.batch_id is not null as asked, g.batch_id is not null as given
          from asked a full outer join given g on a.batch_id = g.batch_id and a.annotation_id = g.annotation_id)
"""


@query("j5_batch_audit", o.sql("reviews labels", BATCHES_SQL + """
  select batch_id, cast(sum(asked::integer) as bigint) as requested, cast(sum(given::integer) as bigint) as answered,
    cast(sum((not given)::integer) as bigint) as missing, cast(sum((not asked)::integer) as bigint) as extra,
    sum((not given)::integer) = 0 and sum((not asked)::integer) = 0 as complete
  from both_ group by batch_id"""))
def j5(spark, d):
    return joins.batch_audit(*_batches(spark, d))


@query("j5_batch_mismatches", o.sql("reviews labels", BATCHES_SQL + """
  select batch_id, annotation_id, case when not given then 'missing' else 'extra' end as status
  from both_ where not (asked and given)"""))
def j5_rows(spark, d):
    return joins.batch_mismatches(*_batches(spark, d))


def _rubric(rows: DataFrame) -> DataFrame:
    return rubric.rubric_score(rows, v.TEST_LEXICON)


@query("j6_complete_gold", o.sql("reviews labels checkpoint", o.rubric_sql(v.TEST_LEXICON, f""",
  last_ as (select *, row_number() over (partition by annotation_id order by batch_seq desc) as rn from checkpoint),
  done as (
    select annotation_id, is_helpful, helpfulness_score, confidence, label_source from last_ where rn = 1
    union all select annotation_id, is_helpful, helpfulness_score, confidence, 'codex_rule_adjudicated' from refined
    where annotation_id not in (select annotation_id from checkpoint))
  select r.annotation_id, d.is_helpful, d.helpfulness_score, d.confidence, d.label_source,
    coalesce(r.manual_label in ('0', '1') and r.manual_label = d.is_helpful::varchar, false) as agrees_with_original
  from review_rows r left join done d on d.annotation_id = r.annotation_id""")))
def j6(spark, d):
    done = joins.complete_gold(v.reviews(spark, d), v.checkpoint(spark, d), _rubric)
    return done.select(
        "annotation_id", "is_helpful", "helpfulness_score", "confidence", "label_source",
        "agrees_with_original",
    )


# --- G: reports ------------------------------------------------------------------------------

LAB = "reviews labels gold"
EDA = "reviews labels gold eda"
SCORE = ("avg_score", "helpfulness_score", 2)
CONF = ("avg_confidence", "confidence", 2)
WORDS = ("avg_word_count", "word_count", 2)


def _section(name: str, key: str, value: str) -> str:
    return (
        f"select '{name}' as section, {key}::varchar as key, cast({value} as double) as value "
        f"from gold where {key} is not null group by {key}"
    )


@query("g01_labeling_report", o.sql(LAB, f""",
  t as (select count(*) as n, count(is_helpful) as done, avg(is_helpful) as rate,
      sum(case when is_helpful is not null and needs_human_review then 1 else 0 end) as queue,
      avg(confidence) as conf,
      avg(case when is_helpful is not null and original_manual_label in ('0','1') then agrees_with_original::integer end) as agree
    from gold_all)
  select 'totals' as section, 'total_source_rows' as key, cast(n as double) as value from t
  union all select 'totals', 'labeled_rows', cast(done as double) from t
  union all select 'totals', 'unlabeled_rows', cast(n - done as double) from t
  union all select 'totals', 'helpful_rate', {o.rnd('rate', 4)} from t
  union all select 'totals', 'human_review_queue_rows', cast(queue as double) from t
  union all select 'totals', 'mean_confidence', {o.rnd('conf', 4)} from t
  union all select 'totals', 'agreement_with_original_binary_labels', {o.rnd('agree', 4)} from t
  union all {_section('label_distribution', 'is_helpful', 'count(*)')}
  union all {_section('helpful_rate_by_rating', 'rating', o.rnd('avg(is_helpful)', 4))}
  union all {_section('helpful_rate_by_sample_group', 'sample_group', o.rnd('avg(is_helpful)', 4))}
  union all {_section('source_distribution', 'label_source', 'count(*)')}"""))
def g01(spark, d):
    return reports.labeling_report(v.gold_all(spark, d))


LABEL_NAME = "case when {0} = 0 then 'Not Helpful' else 'Helpful' end"


@query("g02_label_distribution", o.sql(LAB, f"""
  select help, {LABEL_NAME.format('help')} as label, cast(count(*) as bigint) as count,
    {o.rnd('count(*)::double / (select count(*) from gold) * 100', 2)} as percentage
  from gold group by help"""))
def g02(spark, d):
    return reports.label_distribution(v.gold(spark, d))


@query("g03_by_rating", o.sql(LAB, o.rate_sql("rating", means=[SCORE, CONF, WORDS])))
def g03(spark, d):
    return reports.by_rating(v.gold(spark, d))


@query("g03_by_rating_keep_null", o.sql(LAB, o.rate_sql("rating", keep_null=True)))
def g03_null(spark, d):
    return reports.by_rating(v.gold(spark, d), means={}, keep_null=True)


@query("g04_by_length", o.sql(LAB, o.buckets_sql(
    "length_bucket",
    o.case_buckets("word_count", (-1, 5, 10, 20, 50, None), reports.LENGTH_LABELS),
    reports.LENGTH_LABELS, means=[SCORE, CONF])))
def g04(spark, d):
    return reports.by_length(v.gold(spark, d))


@query("g04_by_length_fine", o.sql(LAB, o.buckets_sql(
    "length_bucket",
    o.case_buckets("word_count", (-1, 5, 10, 20, 40, 80, None), reports.FINE_LENGTH_LABELS),
    reports.FINE_LENGTH_LABELS)))
def g04_fine(spark, d):
    return reports.by_length(v.gold(spark, d), fine=True)


@query("g05_by_sample_group", o.sql(LAB, o.rate_sql("sample_group", means=[SCORE, CONF, WORDS])))
def g05(spark, d):
    return reports.by_sample_group(v.gold(spark, d))


@query("g06_by_score", o.sql(LAB, o.rate_sql(
    "helpfulness_score", means=[("avg_confidence", "confidence", 3)], share=True)))
def g06(spark, d):
    return reports.by_score(v.gold(spark, d))


@query("g07_by_confidence", o.sql(LAB, o.buckets_sql(
    "confidence_bucket",
    o.case_buckets(
        "confidence", ("0.0::double", "0.7::double", "0.8::double", "0.9::double", "1.000001::double"),
        reports.CONFIDENCE_LABELS, right=False),
    reports.CONFIDENCE_LABELS, means=[SCORE], share=True)))
def g07(spark, d):
    return reports.by_confidence(v.gold(spark, d))


@query("g08_by_source", o.sql(LAB, o.rate_sql("label_source", means=[SCORE, CONF, WORDS], share=True)))
def g08(spark, d):
    return reports.by_source(v.gold(spark, d))


@query("g09_by_purchase", o.sql(LAB, o.rate_sql(
    "purchased_int", means=[SCORE, WORDS],
    extra="case when purchased_int = 0 then 'Không xác minh' else 'Đã mua' end as purchase_status")))
def g09(spark, d):
    return reports.by_purchase(v.gold(spark, d))


@query("g10_rubric_by_label", o.sql(LAB, " union all ".join(
    f"select help, '{c}' as criterion, {o.rnd(f'avg({c})', 3)} as average_score, "
    f"{LABEL_NAME.format('help')} as label from gold group by help" for c in RUBRIC_COLUMNS)))
def g10(spark, d):
    return reports.rubric_by_label(v.gold(spark, d))


@query("g11_flag_summary", o.sql(LAB, f"""
  select flag, cast(count(*) as bigint) as occurrence_count, cast(sum(help) as bigint) as helpful_count,
    {o.pct('avg(help)')} as helpful_rate
  from (select help, unnest(case when len(quality_flags) = 0 then ['no_flag'] else quality_flags end) as flag from gold)
  group by flag"""))
def g11(spark, d):
    return reports.flag_summary(v.gold(spark, d))


@query("g11_flag_summary_json", ORACLE["g11_flag_summary"])
def g11_json(spark, d):
    rows = v.gold(spark, d)
    return reports.flag_summary(rows.withColumn("quality_flags", F.to_json("quality_flags")))


def _corr(x: str, y: str) -> str:
    a = f"case when {x} is not null and {y} is not null then cast({x} as double) end"
    b = f"case when {x} is not null and {y} is not null then cast({y} as double) end"
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


@query("g12_correlation_matrix", o.sql(LAB, " union all ".join(
    f"select '{x}' as variable, " + ", ".join(
        f"{o.rnd(_corr(x, y), 3)} as {y}" for y in reports.GOLD_NUMERIC) + " from gold"
    for x in reports.GOLD_NUMERIC)))
def g12(spark, d):
    return reports.correlation_matrix(v.gold(spark, d))


EDA_CORRELATED = (
    "rating", "helpful_count", "purchased_int", "review_char_length", "review_word_length",
    "title_char_length", "content_char_length", "sentence_count", "exclamation_count",
    "digit_count", "created_year", "created_month", "created_hour",
)


@query("g13_target_correlation", o.sql(EDA, " union all ".join(
    f"select '{x}' as variable, {o.rnd(_corr(x, 'help'), 6)} as correlation from eda"
    for x in EDA_CORRELATED)))
def g13(spark, d):
    return reports.target_correlation(eda_features(v.gold(spark, d)), "help", EDA_CORRELATED)


@query("g14_label_profile", o.sql(LAB, f"""
  select help, cast(count(*) as bigint) as review_count, {o.rnd('avg(rating)', 3)} as avg_rating,
    {o.rnd('avg(word_count)', 3)} as avg_word_count, {o.rnd('median(word_count)', 3)} as median_word_count,
    {o.rnd('avg(helpfulness_score)', 3)} as avg_score, {o.rnd('avg(confidence)', 3)} as avg_confidence,
    {o.pct(o.rnd('avg(purchased_int)', 3))} as verified_purchase_rate,
    {LABEL_NAME.format('help')} as label from gold group by help"""))
def g14(spark, d):
    return reports.label_profile(v.gold(spark, d))


@query("g15_summary", o.sql(LAB, f"""
  select cast(count(*) as bigint) as rows, cast(count(*) - count(content) as bigint) as missing_content,
    cast(sum(help) as bigint) as helpful_count, cast(sum(1 - help) as bigint) as not_helpful_count,
    {o.pct('avg(help)')} as helpful_rate, {o.rnd('avg(rating)', 2)} as average_rating,
    {o.rnd('avg(word_count)', 2)} as average_word_count, {o.rnd('avg(helpfulness_score)', 2)} as average_score,
    {o.rnd('avg(confidence)', 3)} as average_confidence, {o.pct('avg(purchased_int)')} as verified_purchase_rate,
    {o.rnd('median(word_count)', 2)} as median_word_count,
    cast(count(*) - count(distinct annotation_id) as bigint) as duplicate_annotation_ids,
    cast(count(*) - count(distinct product_id) as bigint) as duplicate_review_ids,
    'adjudicated,needs_human_review' as removed_columns from gold"""))
def g15(spark, d):
    rows = validate.eda_view(v.gold(spark, d)).withColumn("review_id", F.col("product_id"))
    return reports.summary(rows).withColumn("removed_columns", _text("removed_columns")).drop("columns")


MISSING = ("rating", "manual_label", "is_helpful", "confidence", "review_text")


@query("g16_missing_report", o.sql(LAB, " union all ".join(
    f"""select '{c}' as "column", cast(count(*) - count({c}) as bigint) as missing_count,
    {o.rnd(f'(count(*) - count({c}))::double / count(*) * 100', 2)} as missing_rate_pct from gold_all"""
    for c in MISSING)))
def g16(spark, d):
    return reports.missing_report(v.gold_all(spark, d), MISSING)


PROFILED = {"rating": "int", "manual_label": "string", "product_id": "string", "review_text": "string",
            "confidence": "double"}


@query("g17_column_profile", o.sql(LAB, " union all ".join(
    f"""select '{c}' as "column", '{t}' as dtype, cast(count(*) - count({c}) as bigint) as missing_count,
    {o.rnd(f'(count(*) - count({c}))::double / count(*) * 100', 2)} as missing_rate_pct,
    cast(count(distinct {c}) as bigint) as unique_count from gold_all"""
    for c, t in PROFILED.items())))
def g17(spark, d):
    return reports.column_profile(v.gold_all(spark, d).select(*PROFILED))


@query("g18_metadata_missing", o.sql(LAB, " union all ".join(
    f"""select '{c}' as "column",
    cast(sum(case when trim(coalesce({c}::varchar, '')) = '' then 1 else 0 end) as bigint) as empty_or_missing_count,
    cast(sum(case when trim(coalesce({c}::varchar, '')) = '' then 0 else 1 end) as bigint) as non_empty_count,
    {o.rnd(f"sum(case when trim(coalesce({c}::varchar, '')) = '' then 1 else 0 end)::double / count(*) * 100", 2)}
      as empty_or_missing_rate_pct from gold_all"""
    for c in ("product_name", "category", "helpful_count", "created_at", "title"))))
def g18(spark, d):
    return reports.metadata_missing(
        v.gold_all(spark, d), ("product_name", "category", "helpful_count", "created_at", "title")
    )


@query("g19_quality_counters", o.sql("reviews labels gold", """
  select cast(sum((review_text = '')::integer) as bigint) as empty_text,
    cast(sum((coalesce(is_helpful, -1) not in (0, 1))::integer) as bigint) as label_outside_01,
    cast(count(*) - count(distinct product_id) as bigint) as duplicate_id,
    cast(count(*) - count(distinct review_text) as bigint) as duplicate_text from gold_all"""))
def g19(spark, d):
    return reports.quality_counters(v.gold_all(spark, d), "review_text", "is_helpful", "product_id")


@query("g20_overview", o.sql(EDA, """
  select cast(count(*) as bigint) as rows, min(created_at) as first_created_at, max(created_at) as last_created_at,
    cast(count(distinct product_id) as bigint) as products, cast(count(distinct user_id) as bigint) as users
  from eda"""))
def g20(spark, d):
    return reports.overview(eda_features(v.gold(spark, d)))


DESCRIBED = (
    "rating", "helpful_count", "help", "review_char_length", "review_word_length",
    "title_char_length", "content_char_length", "sentence_count", "exclamation_count",
    "question_count", "digit_count",
)


# Sketches have no SQL; their queries carry what is exact and whether the estimate keeps its error.


@query("g14_label_profile_approx", o.sql(LAB, f"""
  select help, cast(count(*) as bigint) as review_count, {o.rnd('avg(word_count)', 3)} as avg_word_count, true as close from gold group by help"""))
def g14_approx(spark, d):
    rows = materialize(v.gold(spark, d).select("help", "word_count", "rating", "helpfulness_score", "confidence", "purchased_int"))
    report = reports.label_profile(rows, approx=True)
    median = report.select(F.col("help").alias("of"), "median_word_count")
    rank = rows.join(F.broadcast(median), F.col("help") == F.col("of")).groupBy("help").agg(
        F.avg((F.col("word_count") < F.col("median_word_count")).cast("int")).alias("below"),
        F.avg((F.col("word_count") <= F.col("median_word_count")).cast("int")).alias("upto"),
    )
    close = (F.col("below") <= 0.51) & (F.col("upto") >= 0.49)
    return report.join(rank, "help").select("help", "review_count", "avg_word_count", close.alias("close"))


@query("g17_column_profile_approx", o.sql("reviews", """
  select 'review_id' as "column", cast(count(*) filter (where review_id is null) as bigint) as missing_count, true as close from review_rows
  union all select 'rating', cast(count(*) filter (where rating is null) as bigint), true from review_rows
  union all select 'content', cast(count(*) filter (where content is null) as bigint), true from review_rows
  union all select 'user_id', cast(count(*) filter (where user_id is null) as bigint), true from review_rows"""))
def g17_approx(spark, d):
    rows = materialize(v.review_rows(spark, d).select("review_id", "rating", F.md5("content").alias("content"), "user_id"))
    exact = reports.column_profile(rows).select("column", F.col("unique_count").alias("exact"))
    both = reports.column_profile(rows, approx=True).join(exact, "column")
    # Three times the sketch's standard deviation.
    close = F.abs(F.col("unique_count") - F.col("exact")) <= 0.15 * F.col("exact")
    return both.select("column", "missing_count", close.alias("close"))


@query("g20_stored_sketches", o.sql("reviews", """
  select category, cast(count(*) as bigint) as rows, true as users_close, true as reviews_close, true as median_close from review_rows group by category"""))
def g20_sketches(spark, d):
    """Sketches kept per batch of input; one batch is read a second time; all are merged per category."""
    rows = materialize(v.review_rows(spark, d).select("category", "product_id", "user_id", "review_id", "word_count"))
    path = _scratch(spark, "sketches")
    batches = [r["product_id"] for r in rows.select("product_id").distinct().collect()]
    for batch in [*batches, batches[0]]:
        part = rows.where(F.col("product_id").eqNullSafe(F.lit(batch)))
        sketches.store(sketches.sketched(part, ["user_id", "review_id"], ["word_count"], ["category"]), path, str(batch))
    kept = sketches.stored(spark, path)
    counts = sketches.distinct_counts(kept, ["category"]).groupBy("category").agg(
        F.max("rows").alias("rows"), *[F.max(F.when(F.col("column") == c, F.col("estimate"))).alias(c) for c in ("user_id", "review_id")]
    )
    median = sketches.quantile_values(kept, {"median": 0.5}, ["category"]).select(F.col("category").alias("of"), "median")
    exact = rows.join(F.broadcast(median), F.col("category") == F.col("of")).groupBy("category").agg(
        F.count_distinct("user_id").alias("users"), F.count_distinct("review_id").alias("reviews"),
        F.avg((F.col("word_count") < F.col("median")).cast("int")).alias("below"),
        F.avg((F.col("word_count") <= F.col("median")).cast("int")).alias("upto"),
    )
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.05 * F.col(b)
    return counts.join(exact, "category").select(
        "category", "rows", near("user_id", "users").alias("users_close"), near("review_id", "reviews").alias("reviews_close"),
        ((F.col("below") <= 0.51) & (F.col("upto") >= 0.49)).alias("median_close"),
    )


@query("g21_describe", o.sql(EDA, " union all ".join(
    f"""select '{c}' as "column", cast(count({c}) as bigint) as count, {o.rnd(f'avg({c})', 6)} as mean,
    {o.rnd(f'stddev_samp({c})', 6)} as std, cast(min({c}) as double) as min, cast(max({c}) as double) as max, """
    + ", ".join(f"{o.rnd(f'quantile_cont(cast({c} as double), {p})', 6)} as {n}"
                for n, p in reports.DESCRIBE_PERCENTILES.items()) + " from eda"
    for c in DESCRIBED)))
def g21(spark, d):
    return reports.describe(eda_features(v.gold(spark, d)), DESCRIBED)


@query("g22_length_by_label", o.sql(EDA, f"""
  select help, cast(count(*) as bigint) as review_count, {o.rnd('avg(review_word_length)', 2)} as avg_word_count,
    {o.rnd('avg(review_char_length)', 2)} as avg_char_len, {o.rnd('avg(sentence_count)', 2)} as avg_sentence_count,
    {o.rnd('median(review_word_length)', 2)} as median_word_count,
    {o.rnd('median(review_char_length)', 2)} as median_char_len from eda group by help"""))
def g22(spark, d):
    return reports.length_by_label(eda_features(v.gold(spark, d)))


@query("g23_by_vote_presence", o.sql(EDA, f"""
  select has_helpful_vote, cast(count(*) as bigint) as review_count,
    {o.rnd('avg(helpful_count)', 3)} as avg_platform_helpful_count,
    cast(sum(help) as bigint) as labeled_helpful_count, {o.rnd('avg(help)', 3)} as labeled_helpful_rate
  from eda group by has_helpful_vote"""))
def g23(spark, d):
    return reports.by_votes(eda_features(v.gold(spark, d)))


@query("g23_by_vote_bucket", o.sql(EDA, o.buckets_sql(
    "vote_bucket", o.case_buckets("helpful_count", (-1, 0, 1, 2, 5, 10, None), reports.VOTE_LABELS),
    reports.VOTE_LABELS, source="eda")))
def g23_bucket(spark, d):
    return reports.by_votes(eda_features(v.gold(spark, d)), buckets=True)


@query("g24_by_year", o.sql(EDA, o.rate_sql(
    "created_year", source="eda", means=[("avg_word_length", "review_word_length", 6)])))
def g24(spark, d):
    return reports.by_year(eda_features(v.gold(spark, d)))


DAYS = ", ".join(f"({i}, '{n}')" for i, n in enumerate(reports.WEEKDAYS))


@query("g25_by_weekday", o.sql(EDA, f"""
  select w.bucket_order, w.created_weekday, cast(count(e.help) as bigint) as review_count,
    cast(coalesce(sum(e.help), 0) as bigint) as helpful_count, {o.pct('avg(e.help)')} as helpful_rate
  from (values {DAYS}) w(bucket_order, created_weekday) left join eda e on e.created_weekday = w.created_weekday
  group by w.bucket_order, w.created_weekday"""))
def g25(spark, d):
    return reports.by_weekday(eda_features(v.gold(spark, d)))


@query("g26_rating_crosstab", o.sql(LAB, f"""
  select rating, {o.rnd('sum(1 - help) * 100.0::double / count(*)', 6)} as help_0_pct,
    {o.rnd('sum(help) * 100.0::double / count(*)', 6)} as help_1_pct
  from gold where rating is not null group by rating"""))
def g26(spark, d):
    return reports.rating_crosstab(v.gold(spark, d))


@query("g27_rating_by_label", o.sql(LAB, """
  select rating, help, cast(count(*) as bigint) as count from gold group by rating, help"""))
def g27(spark, d):
    return reports.two_way_counts(v.gold(spark, d), "rating", "help")


@query("g27_purchased_by_label", o.sql(LAB, """
  select purchased, help, cast(count(*) as bigint) as count from gold group by purchased, help"""))
def g27_purchased(spark, d):
    return reports.two_way_counts(v.gold(spark, d), "purchased", "help")


@query("g27_rating_counts", o.sql(LAB, """
  select rating, cast(count(*) as bigint) as count from gold group by rating"""))
def g27_rating(spark, d):
    return reports.two_way_counts(v.gold(spark, d), "rating")


@query("g28_normalisation_impact", o.sql(LAB, f"""
  select cast(count(*) as bigint) as rows,
    cast(sum(({o.collapse('content')} = '')::integer) as bigint) as empty_after_clean,
    cast(sum(({o.collapse('content')} <> content)::integer) as bigint) as rows_changed,
    {o.rnd(f"avg(case when help = 0 then {o.words('content')} end)", 2)} as avg_words_label_0,
    {o.rnd(f"avg(case when help = 1 then {o.words('content')} end)", 2)} as avg_words_label_1
  from gold"""))
def g28(spark, d):
    return reports.normalisation_impact(v.gold(spark, d), "content")


def _histogram_sql(source: str, value: str, bins: int, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f""",
  s as (select {keys}cast({value} as double) as x from {source} where {value} is not null),
  r as (select min(x) as lo, max(x) as hi, (max(x) - min(x)) / {bins} as w from s),
  b as (select {keys}cast(least(floor((x - lo) / w), {bins - 1}) as integer) as bin, lo, w from s, r)
  select {keys}bin, cast(count(*) as bigint) as count, {o.rnd('min(lo + bin * w)', 6)} as bin_start,
    {o.rnd('min(lo + (bin + 1) * w)', 6)} as bin_end from b group by {keys}bin"""


@query("g29_histogram", o.sql(EDA, _histogram_sql("eda", "review_word_length", 60)))
def g29(spark, d):
    return reports.histogram(eda_features(v.gold(spark, d)), "review_word_length", 60)


@query("g29_histogram_by_rating", o.sql(EDA, """, p as (
  select *, least(cast(review_word_length as double),
    (select quantile_cont(cast(review_word_length as double), 0.99) from eda where rating is not null)) as clipped
  from eda where rating is not null)""" + _histogram_sql("p", "clipped", 25, "rating, help")))
def g29_facets(spark, d):
    rows = eda_features(v.gold(spark, d)).filter(F.col("rating").isNotNull())
    return reports.histogram(rows, "review_word_length", 25, ["rating", "help"], 0.99)


@query("g30_box_stats", o.sql(EDA, f""",
  p as (select help, least(cast(review_word_length as double),
      (select quantile_cont(cast(review_word_length as double), 0.99) from eda)) as x from eda),
  q as (select help, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.75) as q3
        from p group by help),
  j as (select p.help, x, q1, median, q3, x between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside
        from p join q on p.help = q.help)
  select help, q1, median, q3, cast(count(*) as bigint) as count, min(x) as min, {o.rnd('max(x)', 6)} as max,
    min(case when inside then x end) as whisker_low, max(case when inside then x end) as whisker_high,
    cast(sum((not inside)::integer) as bigint) as outliers from j group by help, q1, median, q3"""))
def g30(spark, d):
    box = reports.box_stats(eda_features(v.gold(spark, d)), "review_word_length")
    return box.withColumn("max", round_even(F.col("max"), 6))


@query("g31_agreement", o.sql("reviews labels predictions", f"""
  select cast(count(*) as bigint) as rows, {o.rnd('avg(cast(coalesce(label = pred, false) as integer))', 6)} as agreement
  from predictions"""))
def g31(spark, d):
    return reports.agreement(v.predictions(spark, d), "label", "pred")


@query("g32_rule_accuracy", o.sql(LAB, f"""
  select cast(count(*) as bigint) as rows,
    {o.rnd('avg(((helpfulness_score >= 4)::integer = help)::integer)', 6)} as rule_accuracy
  from gold where helpfulness_score not between 2 and 3"""))
def g32(spark, d):
    return reports.rule_accuracy(v.gold(spark, d))


CLOUD = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[^0-9a-zA-ZÀ-ỹ\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
STOPS = ", ".join(o.lit(w) for w in v.TEST_LEXICON.stop_words)


@query("g33_word_frequencies", o.sql(LAB, f""",
  t as (select help, unnest(string_split({CLOUD.format('review_text')}, ' ')) as word from gold),
  n as (select help, word, cast(count(*) as bigint) as count from t
        where word <> '' and not regexp_matches(word, '^[0-9]+$') and word not in ({STOPS}) group by help, word),
  r as (select *, cast(row_number() over (partition by help order by count desc, word) as integer) as rank from n)
  select * from r where rank <= 180"""))
def g33(spark, d):
    return reports.word_frequencies(
        v.gold(spark, d), "review_text", stop_words=v.TEST_LEXICON.stop_words
    )


@query("g34_run_summary", o.sql("reviews labels predictions", f"""
  select pred, cast(count(*) as bigint) as count,
    {o.rnd('(select avg(pred) from predictions)', 6)} as helpful_rate from predictions group by pred"""))
def g34(spark, d):
    return reports.run_summary(v.predictions(spark, d), "pred")


# --- W: ranking, sampling, folds, batches -------------------------------------------------------


@query("w1_rank_global", o.sql("reviews labels predictions", """
  select annotation_id, helpfulness_score, original_index,
    cast(row_number() over (order by helpfulness_score desc, original_index) as bigint) as rank,
    (select count(*) from predictions) as count from predictions"""))
def w1(spark, d):
    return ranking.rank_reviews(
        v.predictions(spark, d).select("annotation_id", "helpfulness_score", "original_index")
    )


@query("w1_rank_per_product", o.sql("reviews labels predictions", """
  select annotation_id, product_id, helpfulness_score, original_index,
    cast(row_number() over (partition by product_id order by helpfulness_score desc, original_index) as bigint) as rank,
    cast(count(*) over (partition by product_id) as bigint) as count from predictions"""))
def w1_product(spark, d):
    rows = v.predictions(spark, d)
    return ranking.rank_reviews(
        rows.select("annotation_id", "product_id", "helpfulness_score", "original_index"),
        ["product_id"],
    )


@query("w2_top_k", o.sql("reviews labels predictions", """
  select * from (select product_id, annotation_id, helpfulness_score,
    cast(row_number() over (partition by product_id order by helpfulness_score desc, annotation_id) as integer) as rank
    from predictions) where rank <= 5"""))
def w2(spark, d):
    rows = v.predictions(spark, d).select("product_id", "annotation_id", "helpfulness_score")
    return ranking.top_k(
        rows, ["product_id"], [F.desc("helpfulness_score"), F.col("annotation_id")], 5
    )


@query("w3_sample_per_group", o.sql(LAB, """
  select help, review_id from (select *, row_number() over (partition by help order by md5('42:' || review_id), review_id) as rn from gold)
  where rn <= 100"""))
def w3(spark, d):
    return ranking.sample_per_group(v.gold(spark, d), ["help"], 100).select("help", "review_id")


@query("w3_sample_overall", o.sql(LAB, """
  select review_id from (select *, row_number() over (order by md5('7:' || review_id), review_id) as rn from gold) where rn <= 150"""))
def w3_overall(spark, d):
    return ranking.sample_per_group(v.gold(spark, d), [], 150, seed=7).select("review_id")


@query("w4_stratified_folds", o.sql(LAB, """
  select annotation_id, help, cast((row_number() over (partition by help order by md5('42:' || annotation_id), annotation_id) - 1) % 5 as integer) as fold
  from gold"""))
def w4(spark, d):
    rows = v.gold(spark, d).select("annotation_id", "help")
    return ranking.stratified_folds(rows, "help", 5).select("annotation_id", "help", "fold")


@query("w5_assign_batches", o.sql("reviews", """
  select annotation_id, cast((row_number() over (order by annotation_id) - 1) // 20 as bigint) as batch_id,
    cast((row_number() over (order by annotation_id) - 1) % 20 as integer) as batch_position from review_rows"""))
def w5(spark, d):
    rows = v.reviews(spark, d).select("annotation_id")
    return ranking.assign_batches(rows, 20, [F.col("annotation_id")])


# --- T: text normalisation ------------------------------------------------------------------------


@query("t1_clean_corpus", f"""
  select page_id, {o.collapse("regexp_replace(regexp_replace(lower(html), '<[^>]+>', ' ', 'g'), 'https?://[^[:space:]]+|www\\.[^[:space:]]+', ' ', 'g')")} as clean_text
  from pages""")
def t1(spark, d):
    return clean_corpus(v.pages(spark, d), "html").select("page_id", "clean_text")


@query("t2_nfc_corpus", f"""
  select doc_id, {o.collapse("nfc_normalize(coalesce(text, ''))")} as text from documents""")
def t2(spark, d):
    return nfc_corpus(v.documents(spark, d), ["text"]).select("doc_id", "text")


@query("t3_encoder_ready", f"""
  select doc_id, {o.collapse("nfc_normalize(text)")} as encoder_text, cast(length(text) as integer) as char_len,
    cast({o.words('text')} as integer) as word_count_computed,
    cast(length({o.collapse("nfc_normalize(text)")}) as integer) as encoder_char_len,
    cast({o.words('text')} as integer) as encoder_word_count from documents""")
def t3(spark, d):
    return encoder_ready(v.documents(spark, d), "text").select(
        "doc_id", "encoder_text", "char_len", "word_count_computed", "encoder_char_len",
        "encoder_word_count",
    )


# The supplied pages hold these four entities only, the last one also without its semicolon.
UNESCAPED = """regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g')"""


@query("t3_encoder_ready_pages", f"""
  select page_id, {o.collapse(f"nfc_normalize({UNESCAPED})")} as encoder_text,
    cast(length({o.collapse(f"nfc_normalize({UNESCAPED})")}) as integer) as encoder_char_len,
    cast({o.words(UNESCAPED)} as integer) as encoder_word_count from pages""")
def t3_pages(spark, d):
    return encoder_ready(v.pages(spark, d), "html").select(
        "page_id", "encoder_text", "encoder_char_len", "encoder_word_count"
    )


@query("t4_review_text", o.sql("reviews", f"""
  select annotation_id, review_text,
    {o.collapse("title || ' ' || content")} as model_text from review_rows"""))
def t4(spark, d):
    rows = with_review_text(v.reviews(spark, d))
    return with_review_text(rows, " ", "model_text").select(
        "annotation_id", "review_text", "model_text"
    )


@query("t5_canonical_ids", f"""
  select doc_id, 'MANUAL_' || ({o.PADDED}) as annotation_id from documents""")
def t5(spark, d):
    rows = v.documents(spark, d).select(
        "doc_id", F.concat(F.lit("  manual_"), F.col("doc_id").cast("string"), F.lit(" ")).alias("annotation_id")
    )
    return canonical_ids(rows)


@query("t6_cloud_text", f"select doc_id, {CLOUD.format('text')} as cloud_text from documents")
def t6(spark, d):
    return v.documents(spark, d).select(
        "doc_id", clean_cloud_text("text").alias("cloud_text")
    )


# --- F: features -------------------------------------------------------------------------------------

MODEL_TEXT = o.collapse("title || ' ' || content")


@query("f1_metadata_features", o.sql("reviews", f""",
  m as (select *, {MODEL_TEXT} as t from review_rows)
  select annotation_id, cast(coalesce(rating, 0) as double) as rating, cast(word_count as double) as word_count,
    cast(length(content) as double) as content_len, cast(length(title) as double) as title_len,
    cast(length(t) as double) as text_len, cast({o.strip('title')} <> '' as double) as has_title,
    cast({o.strip('content')} <> '' as double) as has_content,
    cast(length(t) - length(replace(t, '!', '')) as double) as exclamation_count,
    cast(length(t) - length(replace(t, '?', '')) as double) as question_count,
    cast(length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) as double) as digit_count,
    {o.rnd("cast(length(t) - length(regexp_replace(t, '[\\p{Lu}]', '', 'g')) as double) / greatest(length(t), 1)", 6)} as uppercase_ratio,
    cast(coalesce(rating, 0) <= 2 as double) as is_low_rating, cast(coalesce(rating, 0) >= 4 as double) as is_high_rating,
    cast(coalesce(rating, 0) in (1, 5) as double) as is_extreme_rating from m"""))
def f1(spark, d):
    rows = metadata_features(v.review_rows(spark, d)).select("annotation_id", *METADATA_FEATURES)
    return rows.withColumn("uppercase_ratio", round_even(F.col("uppercase_ratio"), 6))


F2_COLUMNS = (
    "review_char_length", "review_word_length", "title_char_length", "content_char_length",
    "sentence_count", "exclamation_count", "question_count", "digit_count", "created_year",
    "created_month", "created_hour", "created_weekday", "has_helpful_vote",
)


@query("f2_eda_features", o.sql(EDA, f"select annotation_id, {', '.join(F2_COLUMNS)} from eda"))
def f2(spark, d):
    return eda_features(v.gold(spark, d)).select("annotation_id", *F2_COLUMNS)


@query("f3_sample_weight", o.sql("labels", f"""
  select annotation_id, {o.rnd('least(1.0::double, greatest(0.5::double, confidence)) * (0.85::double + 0.15::double * least(1.0::double, abs(helpfulness_score - 2.5::double) / 4.5::double))', 6)}
    as sample_weight from label_rows"""))
def f3(spark, d):
    return sample_weight(v.labels(spark, d)).select(
        "annotation_id", round_even(F.col("sample_weight"), 6).alias("sample_weight")
    )


@query("f5_reason_codes", o.sql("reviews", f"""
  select annotation_id, array_to_string({o.reason_sql('review_text', v.TEST_LEXICON)}, ',') as model_reason_codes
  from review_rows"""))
def f5(spark, d):
    return reason_codes(v.review_rows(spark, d), "review_text", v.TEST_LEXICON).select(
        "annotation_id", _text("model_reason_codes")
    )


@query("f6_derived_flags", o.sql("reviews", """
  select annotation_id, purchased_int, word_count from review_rows"""))
def f6(spark, d):
    return derived_flags(with_review_text(v.reviews(spark, d))).select(
        "annotation_id", "purchased_int", "word_count"
    )


# --- R: rubric labelling, decisions, explanations ----------------------------------------------------

RUBRIC_SHOWN = (
    "annotation_id", "is_helpful", "helpfulness_score", "confidence", *RUBRIC_COLUMNS,
    "needs_human_review",
)


@query("r1_rubric_score", o.sql("reviews", o.rubric_sql(v.TEST_LEXICON, "select * from refined")))
def r1(spark, d):
    return _rubric(v.reviews(spark, d)).select(
        *RUBRIC_SHOWN, F.array_join("quality_flags", ",").alias("flags")
    )


@query("r1_rubric_default_lexicon", o.sql("reviews", o.rubric_sql(v.VIETNAMESE, "select * from refined")))
def r1_default(spark, d):
    return rubric.rubric_score(v.reviews(spark, d)).select(
        *RUBRIC_SHOWN, F.array_join("quality_flags", ",").alias("flags")
    )


@query("r2_refine_flags", o.sql(LAB, f""",
  x as (select annotation_id, confidence, {o.refine_list('quality_flags', 'lower(review_text)', 'is_helpful', v.TEST_LEXICON)} as flags from gold)
  select annotation_id, array_to_string(flags, ',') as flags,
    confidence < 0.7 or list_contains(flags, 'ambiguous') or list_contains(flags, 'possible_fake_or_spam') as needs_human_review
  from x"""))
def r2(spark, d):
    return rubric.refine_flags(v.gold(spark, d), "review_text", v.TEST_LEXICON).select(
        "annotation_id", F.array_join("quality_flags", ",").alias("flags"), "needs_human_review"
    )


def _v2(spark, d, patterns):
    scored = rubric_v2.rubric_score_v2(v.review_rows(spark, d), patterns, prefix="")
    return scored.select(
        *RUBRIC_SHOWN[:-1], F.array_join("quality_flags", ",").alias("flags")
    )


@query("r3_rubric_v2", o.sql("reviews", o.rubric_v2_sql(v.TEST_PATTERNS)))
def r3(spark, d):
    return _v2(spark, d, v.TEST_PATTERNS)


@query("r3_rubric_v2_default_patterns", o.sql("reviews", o.rubric_v2_sql(rubric_v2.VIETNAMESE_PATTERNS)))
def r3_default(spark, d):
    return _v2(spark, d, rubric_v2.VIETNAMESE_PATTERNS)


def _responses(spark, d):
    """A response body per product, derived from the labels: one shape per product class.

    Bodies are built from at most 30 labels of a product; further labels of a product go to
    further batches.
    """
    rows = v.gold(spark, d).select(
        "product_id", "annotation_id", "is_helpful", "confidence", "quality_flags", "reason",
        *RUBRIC_COLUMNS,
    )
    batched = ranking.assign_batches(rows, 12, [F.col("product_id"), F.col("annotation_id")])
    broken = F.when(
        F.col("annotation_id").endswith("77"), F.lit(9)
    ).otherwise(F.col("specificity"))
    item = F.struct(
        F.lower("annotation_id").alias("annotation_id"),
        F.col("is_helpful").cast("string").alias("is_helpful"),
        F.col("confidence"),
        "reason",
        F.struct(
            broken.alias("specificity"), "product_experience", "decision_value", "clarity",
            "noise_penalty",
        ).alias("evidence"),
        F.array_append("quality_flags", F.lit("unknown_flag")).alias("quality_flags"),
    )
    grouped = batched.groupBy("batch_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    items = F.to_json("items")
    body = (
        F.when(F.col("batch_id") % 4 == 0, F.concat(F.lit('{"labels": '), items, F.lit("}")))
        .when(F.col("batch_id") % 4 == 1, items)
        .when(F.col("batch_id") % 4 == 2, F.concat(F.lit("```json\n"), items, F.lit("\n```")))
        # The first list of the text counts, whatever the order of the names.
        .otherwise(F.concat(F.lit('{"count": 1, "results": '), items, F.lit(', "another": [{"annotation_id": "later"}]}')))
    )
    return grouped.select("batch_id", body.alias("response_text")), batched


RESPONSES_SQL = f""",
b as (select *, (row_number() over (order by product_id, annotation_id) - 1) // 12 as batch_id from gold),
n as (select cast(batch_id as bigint) as batch_id, annotation_id,
        right(annotation_id, 2) = '77' as broken, helpfulness_score as score, is_helpful as said,
        confidence as conf, quality_flags from b),
p as (select *, case when score >= 4 then 1 when score <= 1 then 0 else said end as is_helpful,
        case when score between 2 and 3 then least(conf, 0.79::double) else conf end as capped,
        list_sort(list_distinct(list_concat(quality_flags, case when score between 2 and 3 then ['ambiguous'] else []::varchar[] end))) as flags
      from n)
"""


@query("r4_normalize_labels", o.sql(LAB, RESPONSES_SQL + f"""
  select batch_id, annotation_id, is_helpful, score as helpfulness_score, {o.rnd('capped', 3)} as confidence,
    array_to_string(flags, ',') as flags,
    capped < 0.7 or list_contains(flags, 'ambiguous') or list_contains(flags, 'possible_fake_or_spam') as needs_human_review
  from p where not broken"""))
def r4(spark, d):
    bodies, _ = _responses(spark, d)
    labels, _ = responses.normalize_labels(responses.explode_responses(bodies))
    return labels.select(
        "batch_id", "annotation_id", "is_helpful", "helpfulness_score", "confidence",
        F.array_join("quality_flags", ",").alias("flags"), "needs_human_review",
    )


@query("r4_rejects", o.sql(LAB, RESPONSES_SQL + """
  select batch_id, annotation_id, 'bad_specificity' as reject_reason from p where broken"""))
def r4_rejects(spark, d):
    bodies, _ = _responses(spark, d)
    _, bad = responses.normalize_labels(responses.explode_responses(bodies))
    return bad.select("batch_id", "annotation_id", "reject_reason")


@query("r5_explode_responses", o.sql(LAB, RESPONSES_SQL + """
  select batch_id, cast(row_number() over (partition by batch_id order by lower(annotation_id)) - 1 as integer) as item_index,
    lower(annotation_id) as annotation_id, case when broken then 9 else specificity end as specificity
  from p join (select annotation_id as id, specificity from label_rows) l on l.id = p.annotation_id"""))
def r5(spark, d):
    bodies, _ = _responses(spark, d)
    items = responses.explode_responses(bodies)
    return items.select(
        "batch_id", "item_index", F.try_variant_get("item", "$.annotation_id", "string").alias("annotation_id"),
        F.try_variant_get("item", "$.evidence.specificity", "int").alias("specificity"),
    )


@query("r6_label_requests", o.sql(LAB, """,
  b as (select *, cast((row_number() over (order by annotation_id) - 1) // 20 as bigint) as batch_id from gold)
  select batch_id, cast(count(*) as bigint) as n_records, string_agg(annotation_id, ',' order by annotation_id) as ids,
    string_agg(content, '' order by annotation_id) as contents from b group by batch_id"""))
def r6(spark, d):
    requests = responses.label_requests(v.gold(spark, d), 20, [F.col("annotation_id")])
    records = F.from_json("records", "array<struct<annotation_id:string,content:string>>")
    return requests.select(
        "batch_id", "n_records",
        F.array_join(F.transform(records, lambda r: r["annotation_id"]), ",").alias("ids"),
        F.array_join(F.transform(records, lambda r: r["content"]), "").alias("contents"),
    )


@query("r7_retry_requests", o.sql(LAB, RESPONSES_SQL + """,
  failed as (select batch_id, count(*) as n from p group by batch_id having sum(broken::integer) > 0)
  select p.annotation_id, n = 1 as exhausted,
    case when n = 1 then p.batch_id::varchar else p.batch_id::varchar || '/' || p.annotation_id end as retry_batch_id
  from p join failed on failed.batch_id = p.batch_id"""))
def r7(spark, d):
    bodies, asked = _responses(spark, d)
    parsed = responses.parsed_labels(responses.explode_responses(bodies))
    status = responses.batch_status(asked, parsed)
    return responses.retry_requests(asked.select("batch_id", "annotation_id"), status).select(
        "annotation_id", "exhausted", "retry_batch_id"
    )


LEVEL = """case when abs({0} - 0.5::double) >= 0.35::double then 'High'
  when abs({0} - 0.5::double) >= 0.2::double then 'Medium' else 'Low' end"""


@query("r8_decide", o.sql("reviews labels predictions", f"""
  select annotation_id, case when proba_helpful >= 0.5 then 'Helpful' else 'Not Helpful' end as label,
    {o.rnd('proba_helpful', 4)} as helpfulness_score, {LEVEL.format('proba_helpful')} as confidence_level
  from predictions"""))
def r8(spark, d):
    rows = v.predictions(spark, d).select("annotation_id", "proba_helpful")
    return explain.decide(rows, "proba_helpful").drop("proba_helpful")


def _criterion(name: str) -> str:
    code, found, absent = explain.CRITERION_LEVELS[name]
    base = f"case when list_contains(codes, '{code}') then {found} else {absent} end"
    more = f"case when list_contains(codes, 'sufficient_detail') then least(100, {base} + 10) else {base} end"
    return f"case when list_contains(codes, 'too_generic') then least(20, {more}) else {more} end"


@query("r9_quality_assessment", o.sql("reviews", f""",
  c as (select annotation_id, {o.reason_sql('review_text', v.TEST_LEXICON)} as codes from review_rows)
  select annotation_id, {o.rnd(' + '.join(f'({_criterion(n)}) * {w}::double' for n, w in explain.QUALITY_WEIGHTS.items()), 1)}
    as information_quality_score, {_criterion('specificity')}::double as specificity,
    {_criterion('balance')}::double as balance from c"""))
def r9(spark, d):
    rows = reason_codes(v.review_rows(spark, d), "review_text", v.TEST_LEXICON)
    done = explain.quality_assessment(rows)
    q = F.col("quality_assessment")
    return done.select(
        "annotation_id", q["information_quality_score"].alias("information_quality_score"),
        q["dimensions"][0]["score"].alias("specificity"), q["dimensions"][2]["score"].alias("balance"),
    )


def _explained(spark, d):
    rows = v.review_rows(spark, d).join(
        v.predictions(spark, d).select("annotation_id", "proba_helpful"), "annotation_id"
    )
    return explain.explain_local(
        explain.decide(reason_codes(rows, "review_text", v.TEST_LEXICON), "proba_helpful")
    )


def _sentences(codes: str, first: str = "") -> str:
    """SQL list of the reason sentences of a list of codes."""
    cases = " ".join(f"when {o.lit(c)} then {o.lit(t)}" for c, t in EXPLANATION["reason"].items())
    return f"list_transform({codes}[1:3], lambda x: {first}case x {cases} end)"


_WHY = f"case when len(codes) = 0 then [{o.lit(EXPLANATION['no_reason'])}] else {_sentences('codes')} end"
_HELPFUL = "p.proba_helpful >= 0.5"


def _either(name: str) -> str:
    return f"case when {_HELPFUL} then {o.lit(EXPLANATION[name + '_helpful'])} else {o.lit(EXPLANATION[name + '_unhelpful'])} end"


def _joined(values: list[str]) -> str:
    return o.lit(" | ".join(values))


@query("r10_explain_local", o.sql("reviews labels predictions", f""",
  c as (select annotation_id, {o.reason_sql('review_text', v.TEST_LEXICON)} as codes from review_rows)
  select c.annotation_id, case when {_HELPFUL} then 'Helpful' else 'Not Helpful' end as label,
    array_to_string({_WHY}, ' | ') as why, array_to_string({_sentences('codes', "x || ': ' || ")}, ' | ') as evidence,
    case when {_HELPFUL} then array_to_string({_WHY}, ' | ') else '' end as strengths,
    case when {_HELPFUL} then '' else {_joined(EXPLANATION['limitations'])} end as limitations,
    case when {_HELPFUL} then {_joined(EXPLANATION['missing_helpful'])} else {_joined(EXPLANATION['missing_unhelpful'])} end as missing,
    {_either('assessment')} as assessment, {_either('suggestion')} as suggestion, {_either('buyer_value')} as buyer_value,
    'local_fallback' as source
  from c join predictions p on p.annotation_id = c.annotation_id"""))
def r10(spark, d):
    e = F.col("explanation")
    evidence = F.transform(e["evidence_analysis"], lambda x: F.concat(x["criterion"], F.lit(": "), x["analysis"]))
    return _explained(spark, d).select(
        "annotation_id", "label", F.array_join(e["why"], " | ").alias("why"), F.array_join(evidence, " | ").alias("evidence"),
        F.array_join(e["strengths"], " | ").alias("strengths"), F.array_join(e["limitations"], " | ").alias("limitations"),
        F.array_join(e["missing_information"], " | ").alias("missing"), e["short_assessment"].alias("assessment"),
        e["improvement_suggestion"].alias("suggestion"), e["buyer_value"].alias("buyer_value"), e["source"].alias("source"),
    )


def _remote_answer():
    return F.when(
        F.col("rating").isNotNull(),
        F.to_json(
            F.struct(
                F.array(F.col("title")).alias("why"),
                F.lit("not a list").alias("strengths"),
                F.col("title").alias("short_assessment"),
                F.struct(F.lit("Wrong").alias("label")).alias("score_interpretation"),
                F.struct((F.col("rating") * 25).alias("specificity"), F.lit("60").alias("balance"))
                .alias("rubric_scores"),
            )
        ),
    )


@query("r11_merge_explanations", o.sql("reviews labels predictions", f""",
  x as (select r.*, p.proba_helpful from review_rows r join predictions p on p.annotation_id = r.annotation_id)
  select annotation_id, case when proba_helpful >= 0.5 then 'Helpful' else 'Not Helpful' end as label,
    case when rating is null then 'local_fallback' else 'remote' end as source,
    case when rating is not null then title end as why_remote,
    case when rating is not null then
      {o.rnd('least(100.0::double, rating * 25) * 0.2::double + 60.0::double * 0.15::double', 1)} end as remote_quality
  from x"""))
def r11(spark, d):
    rows = _explained(spark, d).withColumn("remote_json", _remote_answer())
    merged = explain.merge_explanations(rows)
    e = F.col("explanation")
    remote = e["source"] == "remote"
    return merged.select(
        "annotation_id", e["score_interpretation"]["label"].alias("label"), e["source"].alias("source"),
        F.when(remote, e["why"][0]).alias("why_remote"),
        F.when(remote, e["quality_assessment"]["information_quality_score"]).alias("remote_quality"),
    )


@query("r12_response_status", """
  select event_id, case when event_type = 'error' then 'remote_http_' || (400 + cast(json_extract_string(props, '$.k') as integer))::varchar
    when event_type = 'signup' then 'remote_timeout' when event_type = 'view' then 'remote_max_tokens'
    when event_type = 'click' then 'remote_invalid_json' end as fallback_reason from events""")
def r12(spark, d):
    kind = F.col("event_type")
    rows = v.table(spark, d, "events").select(
        "event_id",
        F.when(kind == "error", 400 + F.get_json_object("props", "$.k").cast("int"))
        .otherwise(200).alias("http_status"),
        F.when(kind == "signup", "timeout").alias("error_kind"),
        F.when(kind == "view", "MAX_TOKENS").otherwise("STOP").alias("finish_reason"),
        F.when(kind == "click", "{broken").otherwise(F.col("props")).alias("response_text"),
    )
    return explain.response_status(rows).select("event_id", "fallback_reason")


@query("r13_explain_requests", o.sql("reviews", f"""
  select annotation_id, review_text, rating from review_rows"""))
def r13(spark, d):
    rows = explain.explain_requests(_explained(spark, d))
    return rows.select(
        "annotation_id",
        F.get_json_object("review_json", "$.review_text").alias("review_text"),
        F.get_json_object("product_json", "$.rating").cast("int").alias("rating"),
    )


# --- M: modelling ------------------------------------------------------------------------------------

#: The smallest mode in use: that of a smoke run (3 x 2 folds, 100 trees, 150 rounds).
MODE = stack.FAST


@query("m1_hash_embed", f""",
  w as (select doc_id, list_filter(string_split({o.collapse('lower(text)')}, ' '), lambda x: x <> '') as ws from documents)
  select doc_id, cast(coalesce(list_sum(list_transform(ws, lambda x: greatest(length(x), 0) + greatest(length(x) - 1, 0) + greatest(length(x) - 2, 0))), 0) as bigint) as ngrams,
    case when len(ws) > 0 then 1.0::double else 0.0::double end as norm from w""".replace(",\n  w as", "with w as", 1))
def m1(spark, d):
    docs = v.documents(spark, d).select("doc_id", "text")
    both = embed.hash_embed(embed.hash_embed(docs, "text"), "text", output="counts", normalize=False)
    squares = F.aggregate(
        vector_to_array("embedding"), F.lit(0.0), lambda acc, x: acc + x * x
    )
    total = F.aggregate(vector_to_array("counts"), F.lit(0.0), lambda acc, x: acc + x)
    return both.select(
        "doc_id", total.cast("long").alias("ngrams"), round_even(F.sqrt(squares), 4).alias("norm")
    )


def _tiny_encoder():
    def encoder(texts: np.ndarray) -> np.ndarray:
        return np.array([[len(t), t.count(" ")] for t in texts], dtype=np.float32)

    return encoder


@query("m2_encode", """
  select doc_id, cast(length(text) as double) as dim0,
    cast(length(text) - length(replace(text, ' ', '')) as double) as dim1 from documents""")
def m2(spark, d):
    path = _scratch(spark, "embeddings")
    docs = v.documents(spark, d).select("doc_id", "text")
    cached = embed.encode_cached(docs, "doc_id", "text", _tiny_encoder, path)
    return cached.select(
        "doc_id", F.col("embedding")[0].cast("double").alias("dim0"),
        F.col("embedding")[1].cast("double").alias("dim1"),
    )


# Values of trees and regressions have no SQL. Their queries return every labelled review, with
# tests that a constant or shuffled score fails: how well scores rank the rows they were fit on
# (AUC), and that a saved model scores as the fitted one. Ridge, scaler and weights have SQL.
TRAINED = f"""with ids as (
  select d.doc_id, d.text from documents d join events v on v.event_id = d.doc_id where regexp_matches(d.text, '\\S')),
t as (select 'MANUAL_' || ({o.PADDED}) as annotation_id, quality as label
  from (select i.doc_id, l.quality from ids i join labels l on l.doc_id = i.doc_id) x)
"""
#: AUC on the training rows that trees and logistic regression have to pass.
TREES_RANK, LOGISTIC_RANKS = 0.95, 0.6


def _between(column: str, low: float, high: float) -> F.Column:
    return F.col(column).between(low, high)


def _rows(spark, d):
    return stack.training_rows(v.training(spark, d))


def _ranks(scored: DataFrame, score: str, least: float) -> F.Column:
    """Whether a score ranks the labels of its table with at least that AUC."""
    auc = metrics.ranking_metrics(materialize(scored.select("label", score)), "label", score)
    return F.lit(bool(auc.first()["roc_auc"] >= least)).alias("ranks")


@query("m3_rf_features", TRAINED + "select annotation_id, label, 1.0::double as total, true as valid, true as ranks from t")
def m3(spark, d):
    rows = _rows(spark, d)
    scored = stack.rf_features(rows, stack.rf_model(rows, MODE, 7))
    low, high = (F.col(c) for c in stack.RF_FEATURES)
    return scored.select(
        "annotation_id", "label", round_even(low + high, 6).alias("total"),
        ((low >= 0) & (high >= 0)).alias("valid"), _ranks(scored, stack.RF_FEATURES[1], TREES_RANK),
    )


@query("m4_assemble", """
  select cast(count(*) as bigint) as rows, cast(384 + 14 as integer) as width from labels l
  join documents d on d.doc_id = l.doc_id where regexp_matches(d.text, '\\S')""")
def m4(spark, d):
    rows = _rows(spark, d)
    parts = [stack.embedding_array(), *[F.col(c) for c in METADATA_FEATURES]]
    done = stack.assemble(rows, parts, "features", embed.HASH_DIMENSION + len(METADATA_FEATURES))
    return done.groupBy(F.size(vector_to_array("features")).alias("width")).agg(
        F.count("*").alias("rows")
    )


@query("m5_boosted_trees", TRAINED + "select annotation_id, label, true as valid, true as ranks from t")
def m5(spark, d):
    rows = _rows(spark, d)
    model = stack.boosted(rows, "embedding", MODE, 7)
    scored = stack.with_probability(model, rows, "embedding")
    return scored.select(
        "annotation_id", "label", _between("proba_helpful", 0, 1).alias("valid"),
        _ranks(scored, "proba_helpful", TREES_RANK),
    )


@query("m6_logistic_baseline", TRAINED + "select annotation_id, label, true as valid, true as ranks from t")
def m6(spark, d):
    rows = _rows(spark, d)
    names = stack.usable_metadata(rows)
    ready = stack.assemble(rows, stack.scaled(stack.fit_scaler(rows, names)), "_x")
    model = stack.logistic(ready, "_x", MODE)
    scored = stack.with_probability(model, ready, "_x")
    return scored.select(
        "annotation_id", "label", _between("proba_helpful", 0, 1).alias("valid"),
        _ranks(scored, "proba_helpful", LOGISTIC_RANKS),
    )


@query("m7_aux_regressors", TRAINED + "select annotation_id, true as valid, true as fits from t")
def m7(spark, d):
    rows = _rows(spark, d)
    scaler = stack.fit_scaler(rows, stack.usable_metadata(rows))
    scored = stack.aux_features(rows, stack.aux_regressors(rows, scaler), scaler)
    valid = _between(stack.AUX_FEATURES[0], -2, 7) & _between(stack.AUX_FEATURES[1], 0, 1)
    # A constant has the variance as its error, a shuffled prediction more.
    errors = scored.agg(*[
        (F.avg((F.col(t) - F.col(p)) ** 2) < 0.9 * F.var_pop(t)).alias(t) for t, p in zip(stack.AUX_TARGETS, stack.AUX_FEATURES)
    ]).first()
    return scored.select("annotation_id", valid.alias("valid"), F.lit(all(errors)).alias("fits"))


@query("m7_ridge", o.sql("reviews", f""",
  f as (select annotation_id, cast(word_count as double) as a, cast(helpful_count as double) as b,
          cast(length(content) as double) as y from review_rows),
  m as (select count(*) as n, avg(a) as ma, avg(b) as mb, avg(y) as my, var_pop(a) * count(*) + 10 as aa,
          var_pop(b) * count(*) + 10 as bb, covar_pop(a, b) * count(*) as ab,
          covar_pop(a, y) * count(*) as ay, covar_pop(b, y) * count(*) as byy from f),
  c as (select *, (ay * bb - byy * ab) / (aa * bb - ab * ab) as wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) as wb from m)
  select annotation_id, {o.rnd('my + wa * (a - ma) + wb * (b - mb)', 3)} as predicted from f, c"""))
def m7_ridge(spark, d):
    rows = v.review_rows(spark, d).withColumn("_y", F.length("content").cast("double"))
    rows = materialize(rows.select("annotation_id", "word_count", "helpful_count", "_y"))
    ready = stack.assemble(rows, [F.col("word_count"), F.col("helpful_count")], "_x", 2)
    scored = stack.ridge(ready, "_x", "_y").transform(ready)
    return scored.select("annotation_id", round_even(F.col("_ridge"), 3).alias("predicted"))


FOLD_RIDGE = """,
  f as (select annotation_id, cast(doc_id % 3 as integer) as fold, cast(word_count as double) as a, cast(helpful_count as double) as b,
          cast(length(content) as double) as y from review_rows),
  m as (select k.fold, count(*) as n, avg(a) as ma, avg(b) as mb, avg(y) as my, var_pop(a) * count(*) + 10 as aa,
          var_pop(b) * count(*) + 10 as bb, covar_pop(a, b) * count(*) as ab,
          covar_pop(a, y) * count(*) as ay, covar_pop(b, y) * count(*) as byy
        from f join (select distinct fold from f) k on k.fold <> f.fold group by k.fold),
  c as (select *, (ay * bb - byy * ab) / (aa * bb - ab * ab) as wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) as wb from m)
"""


def _fold_ridge(spark, d):
    rows = v.review_rows(spark, d).withColumn("_y", F.length("content").cast("double"))
    rows = rows.select("annotation_id", "word_count", "helpful_count", "_y", (F.col("doc_id") % 3).cast("int").alias("fold"))
    return moments.oof_ridge(materialize(rows), ["word_count", "helpful_count"], "_y", "fold", stack.RIDGE_ALPHA)


@query("m7_fold_ridge", o.sql("reviews", FOLD_RIDGE + f"""
  select annotation_id, f.fold, {o.rnd('my + wa * (a - ma) + wb * (b - mb)', 3)} as predicted from f join c on c.fold = f.fold"""))
def m7_fold_ridge(spark, d):
    """Each row predicted by the model of the other folds; one pass fits all of them."""
    scored, _ = _fold_ridge(spark, d)
    return scored.select("annotation_id", "fold", round_even(F.col("oof_prediction"), 3).alias("predicted"))


@query("m7_fold_coefficients", o.sql("reviews", FOLD_RIDGE + f"""
  select fold, {o.rnd('wa', 9)} as w_word_count, {o.rnd('wb', 9)} as w_helpful_count, {o.rnd('my - wa * ma - wb * mb', 7)} as intercept from c"""))
def m7_fold_coefficients(spark, d):
    _, models = _fold_ridge(spark, d)
    rows = [(f, *map(float, beta), float(intercept)) for f, (beta, intercept) in models.items()]
    made = spark.createDataFrame(rows, "fold int, w_word_count double, w_helpful_count double, intercept double")
    return made.select("fold", *[round_even(F.col(c), k).alias(c) for c, k in (("w_word_count", 9), ("w_helpful_count", 9), ("intercept", 7))])


@query("m8_scale_metadata", o.sql("reviews", f"""
  select annotation_id,
    {o.rnd('(word_count - (select avg(word_count) from review_rows)) / (select stddev_pop(word_count) from review_rows)', 6)} as scaled_word_count,
    {o.rnd('(helpful_count - (select avg(helpful_count) from review_rows)) / (select stddev_pop(helpful_count) from review_rows)', 6)} as scaled_helpful_count
  from review_rows"""))
def m8(spark, d):
    rows = v.review_rows(spark, d)
    done = stack.scale_metadata(rows, stack.fit_scaler(rows, ["word_count", "helpful_count"]))
    return done.select(
        "annotation_id",
        *[round_even(F.col(f"scaled_{c}"), 6).alias(f"scaled_{c}") for c in ("word_count", "helpful_count")],
    )


@query("m9_class_weights", """
  select doc_id, quality as label, round((select count(*) from labels)::double
    / (2 * (select count(*) from labels x where x.quality = l.quality)), 6) as weight from labels l""")
def m9(spark, d):
    rows = v.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    weighted = stack.with_class_weight(rows, stack.class_weights(rows), output="weight")
    return weighted.withColumn("weight", F.round("weight", 6))


@query("m10_nested_oof", TRAINED + "select annotation_id, label, 1.0::double as total, true as valid from t")
def m10(spark, d):
    rows = _rows(spark, d)
    train, _, _ = stack.nested_oof(rows, None, stack.usable_metadata(rows), MODE, 42)
    valid = _between(stack.AUX_FEATURES[0], -2, 7) & _between(stack.AUX_FEATURES[1], 0, 1)
    total = F.col(stack.RF_FEATURES[0]) + F.col(stack.RF_FEATURES[1])
    return train.select(
        "annotation_id", "label", round_even(total, 6).alias("total"), valid.alias("valid")
    )


@query("m11_outer_cv", TRAINED + f""", n as (select label, count(*) as n from t group by label),
  f as (select fold, cast(sum((n - fold + 2) // 3) as bigint) as rows, cast(sum(case when label = 1 then (n - fold + 2) // 3 end) as bigint) as helpful
        from n, (values (0), (1), (2)) k(fold) group by fold)
  select cast(fold + 1 as integer) as fold, model, rows, helpful, true as valid
  from f, (values {", ".join(f"('{c}')" for c in stack.CANDIDATES)}) c(model)""")
def m11(spark, d):
    scores, _ = stack.outer_cv(_rows(spark, d), MODE)
    valid = F.lit(True)
    for name in metrics.METRIC_NAMES:
        valid = valid & _between(name, 0, 1)
    return scores.select(
        "fold", "model", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("rows"),
        (F.col("fn") + F.col("tp")).alias("helpful"), valid.alias("valid"),
    )


#: Models of the out-of-fold rows: their folds, texts and order are compared, not their quality.
LIGHT = stack.Settings(outer_folds=3, inner_folds=2, trees=10, rf_depth=8, rounds=5, step=0.3, logistic_iterations=50)


@query("m11_oof_rows", o.sql(LAB, f"""
  select annotation_id, cast((row_number() over (partition by is_helpful order by md5('42:' || annotation_id), annotation_id) - 1) % 3 + 1 as integer) as fold,
    is_helpful as label, review_id, sample_group, title, content, true as valid
  from gold where regexp_matches(title || content, '\\S')"""))
def m11_rows(spark, d):
    _, oof = stack.outer_cv(_rows(spark, d), LIGHT, reviews=v.gold(spark, d))
    decided = (F.col("proba_helpful") >= 0.5).cast("int") == F.col("pred")
    valid = decided & _between("proba_helpful", 0, 1) & _between("pred_helpfulness_score", -2, 7) & _between("pred_confidence", 0, 1)
    return oof.select("annotation_id", "fold", "label", *stack.OOF_COLUMNS, valid.alias("valid"))


METRICS_SQL = f""",
s as (select {{keys}} proba_helpful as score, label, pred from predictions where label is not null),
lv as (select {{keys}} score, sum(label) as pos, sum(1 - label) as neg from s group by {{keys}} score),
cu as (select *, sum(pos) over (partition by {{part}} order by score desc) as tp,
         sum(neg) over (partition by {{part}} order by score desc) as fp from lv),
rk as (select {{keys}} sum(neg * (tp - pos + pos / 2.0::double)) / nullif(sum(pos) * sum(neg), 0)::double as roc_auc,
         coalesce(sum(pos * (tp::double / (tp + fp))) / nullif(sum(pos), 0), 0.0::double) as pr_auc from cu group by {{group}}),
cm as (select {{keys}} sum((label = 0 and pred = 0)::integer) as tn, sum((label = 0 and pred = 1)::integer) as fp,
         sum((label = 1 and pred = 0)::integer) as fn, sum((label = 1 and pred = 1)::integer) as tp from s group by {{group}}),
mt as (select cm.*, rk.roc_auc, rk.pr_auc, (tp + tn)::double / (tn + fp + fn + tp) as accuracy,
         coalesce(tp::double / nullif(tp + fp, 0), 0.0::double) as precision, coalesce(tp::double / nullif(tp + fn, 0), 0.0::double) as recall,
         coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0.0::double) as f1 from cm join rk on {{join}})
"""
METRIC_COLUMNS = ", ".join(
    [f"{o.rnd(n, 6)} as {n}" for n in metrics.METRIC_NAMES]
    + [f"{o.big(c)} as {c}" for c in ("tn", "fp", "fn", "tp")]
)
PRED = "reviews labels predictions"
WHOLE = METRICS_SQL.format(keys="", part="1", group="1 = 1", join="true")
PER_FOLD = METRICS_SQL.format(
    keys="fold, model,", part="fold, model", group="fold, model",
    join="cm.fold = rk.fold and cm.model = rk.model",
)
WHOLE = WHOLE.replace("group by  score", "group by score").replace(" group by 1 = 1", "")


def _known(spark, d):
    return v.predictions(spark, d).filter(F.col("label").isNotNull())


@query("m12_binary_metrics", o.sql(PRED, WHOLE + f"select {METRIC_COLUMNS} from mt"))
def m12(spark, d):
    return metrics.binary_metrics(_known(spark, d), rounded=6)


@query("m12_metrics_by_fold", o.sql(PRED, PER_FOLD + f"select fold, model, {METRIC_COLUMNS} from mt"))
def m12_fold(spark, d):
    return metrics.binary_metrics(_known(spark, d), by=["fold", "model"], rounded=6)


CONTINUOUS = """,
predictions as (select is_helpful as label, cast(helpful_count >= 20 as integer) as pred,
  1.0::double / (1 + word_count + helpful_count / 7.0::double + doc_id / 1000003.0::double) as proba_helpful from gold_all)
"""


@query("m12_continuous_score", o.sql("reviews labels gold", CONTINUOUS + WHOLE + f"select {METRIC_COLUMNS} from mt"))
def m12_continuous(spark, d):
    """A score that differs in nearly every row, in late digits only."""
    rows = v.gold_all(spark, d).filter(F.col("is_helpful").isNotNull())
    score = 1 / (1 + F.col("word_count") + F.col("helpful_count") / 7.0 + F.col("doc_id") / 1000003.0)
    rows = rows.select(
        F.col("is_helpful").alias("label"), (F.col("helpful_count") >= 20).cast("int").alias("pred"),
        score.alias("proba_helpful"),
    )
    return metrics.binary_metrics(rows, rounded=6)


_SUMMARY = ", ".join(
    f"{o.rnd(f'avg({n})', 6)} as {n}_mean"
    + ("" if n in ("roc_auc", "pr_auc") else f", {o.rnd(f'stddev_samp({n})', 6)} as {n}_std")
    for n in metrics.METRIC_NAMES
)


@query("m13_cv_summary", o.sql(PRED, PER_FOLD + f"select model, {_SUMMARY} from mt group by model"))
def m13(spark, d):
    return metrics.cv_summary(metrics.binary_metrics(_known(spark, d), by=["fold", "model"]))


@query("m13_ablation_delta", o.sql(PRED, PER_FOLD + f"""
  select {o.rnd("avg(case when model = 'en' then f1 end)", 6)} as base_mean,
    {o.rnd("avg(case when model = 'fr' then f1 end)", 6)} as extended_mean,
    {o.rnd("avg(case when model = 'fr' then f1 end) - avg(case when model = 'en' then f1 end)", 6)} as delta from mt"""))
def m13_delta(spark, d):
    scores = metrics.binary_metrics(_known(spark, d), by=["fold", "model"])
    return metrics.ablation_delta(scores, "en", "fr")


@query("m14_class_report", o.sql(PRED, WHOLE + f"""
  select 0 as class, {o.rnd('coalesce(tn::double / nullif(tn + fn, 0), 0)', 4)} as precision,
    {o.rnd('coalesce(tn::double / nullif(tn + fp, 0), 0)', 4)} as recall,
    {o.rnd('coalesce(2.0::double * tn / nullif(2 * tn + fn + fp, 0), 0)', 4)} as f1, cast(tn + fp as bigint) as support from cm
  union all select 1, {o.rnd('coalesce(tp::double / nullif(tp + fp, 0), 0)', 4)},
    {o.rnd('coalesce(tp::double / nullif(tp + fn, 0), 0)', 4)},
    {o.rnd('coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0)', 4)}, cast(tp + fn as bigint) from cm"""))
def m14(spark, d):
    return metrics.class_report(_known(spark, d))


def _oof_report(spark, d) -> dict[str, DataFrame]:
    rows = _known(spark, d).withColumns({"pred_helpfulness_score": F.col("proba_helpful") * 9 - 2, "pred_confidence": F.col("proba_helpful")})
    return metrics.oof_report(rows)


@query("m14_oof_confusion", o.sql(PRED, """
  select label, pred, cast(count(*) as bigint) as count from predictions where label is not null group by label, pred"""))
def m14_confusion(spark, d):
    return _oof_report(spark, d)["confusion"]


@query("m14_oof_metrics", o.sql(PRED, WHOLE + f"select {METRIC_COLUMNS} from mt"))
def m14_metrics(spark, d):
    pooled = _oof_report(spark, d)["metrics"]
    return pooled.select(*[round_even(F.col(n), 6).alias(n) for n in metrics.METRIC_NAMES], "tn", "fp", "fn", "tp")


_QUARTILES = ", ".join(f"{o.rnd(f'quantile_cont(value, {p})', 6)} as {n}" for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))


@query("m14_oof_auxiliary", o.sql(PRED, f""",
  k as (select 'pred_helpfulness_score' as "column", proba_helpful * 9 - 2 as value from predictions where label is not null
        union all select 'pred_confidence', proba_helpful from predictions where label is not null)
  select "column", cast(count(*) as bigint) as count, {o.rnd('avg(value)', 6)} as mean, {o.rnd('stddev_samp(value)', 6)} as std,
    min(value) as min, max(value) as max, {_QUARTILES} from k group by "column" """))
def m14_auxiliary(spark, d):
    return _oof_report(spark, d)["auxiliary"]


@query("m15_train_and_predict", TRAINED + "select annotation_id, true as consistent, true as valid, true as reloaded, 'stacked_trees' as model_variant from t")
def m15(spark, d):
    path = _scratch(spark, "model")
    fitted = stack.train_final(_rows(spark, d), path, MODE)
    rows = materialize(v.training(spark, d).drop("is_helpful", "helpfulness_score", "confidence"))
    shown = ["helpfulness_score", "predicted_rubric_score", "predicted_annotation_confidence"]
    again = stack.predict(rows, fitted).select("annotation_id", F.struct(*shown).alias("_fitted"))
    scored = stack.predict(rows, path).join(again, "annotation_id")
    score = F.col("helpfulness_score")
    helpful = F.col("label") == "Helpful"
    return scored.select(
        "annotation_id",
        # The rounded score may sit on the threshold itself.
        ((helpful & (score >= 0.5)) | (~helpful & (score <= 0.5))).alias("consistent"),
        (_between("predicted_rubric_score", -2, 7) & _between("predicted_annotation_confidence", 0, 1)
         & F.col("confidence_level").isin("High", "Medium", "Low")).alias("valid"),
        F.struct(*shown).eqNullSafe(F.col("_fitted")).alias("reloaded"),
        "model_variant",
    )


@query("score_and_rank", o.sql("reviews requests", f""",
  ok as (select * from requests where length(product_name) between 1 and 200 and length(category) between 1 and 100
           and rating between 1 and 5 and length(review_text) between 1 and 10000 and {o.strip('review_text')} <> ''
           and not (coalesce(price, 0) < 0) and not (length(brand) > 100)),
  sc as (select *, cast(original_index * 7919 % 200 as double) / 200 as helpfulness_score from ok)
  select annotation_id, category, helpfulness_score, original_index,
    cast(row_number() over (partition by category order by helpfulness_score desc, original_index) as bigint) as rank,
    cast(count(*) over (partition by category) as bigint) as count from sc"""))
def ranked_requests(spark, d):
    def score(rows: DataFrame) -> DataFrame:
        pseudo = (F.col("original_index") * 7919 % 200).cast("double") / 200
        return rows.withColumn("helpfulness_score", pseudo).select(
            "annotation_id", "category", "helpfulness_score", "original_index"
        )

    return flows.score_and_rank(v.requests(spark, d), score, ["category"])[0]


@query("flow_labelling_loop", o.sql(LAB, RESPONSES_SQL + """,
  q as (select p.*, (row_number() over (order by annotation_id) - 1) // 20 as request from p),
  f as (select request, max(broken::integer) as failed from q group by request)
  select q.annotation_id, q.is_helpful, q.score as helpfulness_score, f.failed as batch_seq from q join f on f.request = q.request"""))
def labelling_loop(spark, d):
    """Requests, answers of which one spoils its batch, the checkpoint, resumption and the gold table."""
    out, truth = _scratch(spark, "loop"), v.labels(spark, d)
    source = materialize(v.review_rows(spark, d).join(truth, "annotation_id", "left_semi"))

    def turn(checkpoint: DataFrame | None, number: int) -> None:
        requests = flows.next_requests(source, checkpoint, 20)
        ids = F.explode(F.from_json("records", "array<struct<annotation_id:string>>"))
        asked = materialize(requests.select("batch_id", ids.alias("r")).select("batch_id", "r.annotation_id"))
        spoiled = F.when(F.col("annotation_id").endswith("77") & (F.lit(number) == 0), 9).otherwise(F.col("specificity"))
        points = F.struct(spoiled.alias("specificity"), *[c for c in RUBRIC_COLUMNS if c != "specificity"])
        item = F.struct("annotation_id", "is_helpful", "confidence", "reason", points.alias("evidence"), "quality_flags")
        bodies = asked.join(truth, "annotation_id").groupBy("batch_id").agg(
            F.concat(F.lit('{"labels": '), F.to_json(F.collect_list(item)), F.lit("}")).alias("response_text")
        )
        flows.accept_responses(asked, materialize(bodies), source, out, number, v.TEST_LEXICON)

    turn(None, 0)
    turn(io.read_checkpoint(spark, out), 1)
    done = io.read_checkpoint(spark, out).select("annotation_id", F.col("batch_seq").cast("int"))
    gold = flows.gold_outputs(source, out)["gold"].select("annotation_id", "is_helpful", "helpfulness_score")
    return gold.join(done, "annotation_id")


# --- ST: streaming ---------------------------------------------------------------------------------------


@query("st1_score_stream", o.sql("reviews", o.rubric_sql(v.TEST_LEXICON, f""",
  c as (select annotation_id, {o.reason_sql('review_text', v.TEST_LEXICON)} as codes from review_rows)
  select r.annotation_id, r.is_helpful, r.helpfulness_score, r.confidence, r.flags,
    array_to_string(c.codes, ',') as codes from refined r join c on c.annotation_id = r.annotation_id""")))
def st1(spark, d):
    columns = ["annotation_id", "review_id", "product_id", "title", "content", "manual_label"]
    source = materialize(v.reviews(spark, d).select(*columns))
    path, out, state = source.inputFiles()[0].rsplit("/", 1)[0], _scratch(spark, "scored"), _scratch(spark, "state")
    stream = read_review_stream(spark, path, source.schema)
    score_stream(stream, out, state, v.TEST_LEXICON).awaitTermination()
    scored = spark.read.parquet(out)
    return scored.select(
        "annotation_id", "is_helpful", "helpfulness_score", "confidence",
        F.array_join("quality_flags", ",").alias("flags"),
        F.array_join("model_reason_codes", ",").alias("codes"),
    )


@query("st1_checkpoint_stream", o.sql("reviews", o.rubric_sql(v.TEST_LEXICON, """
  select annotation_id, is_helpful, helpfulness_score, confidence, flags, true as once from refined""")))
def st1_checkpoint(spark, d):
    """A stream of three batches that is lost between a write and its commit, run again, and followed
    by a second stream over the same files."""
    columns = ["annotation_id", "review_id", "product_id", "title", "content", "manual_label"]
    source, inbox, out = v.reviews(spark, d).select(*columns), _scratch(spark, "inbox"), _scratch(spark, "labels")
    # Three batches of as many files each as keep a task's share bounded, however large the table.
    per_batch = batch_files(v.table(spark, d, "documents"), 3)
    source.repartition(3 * per_batch).write.parquet(inbox)
    state, lost = _scratch(spark, "state"), []

    def lose(number: int) -> None:
        if number == 1 and not lost:
            lost.append(number)
            raise RuntimeError("lost between write and commit")

    def run(state: str) -> None:
        stream = read_review_stream(spark, inbox, source.schema, files_per_trigger=per_batch)
        checkpointing.label_stream(stream, out, state, lambda rows: checkpointing.rubric_labels(rows, v.TEST_LEXICON), lose).awaitTermination()

    try:
        run(state)
    except StreamingQueryException:
        pass
    run(state)
    run(_scratch(spark, "state"))
    log = checkpointing.commit_log(spark, out)
    done = log.agg(F.sum("rows"), F.count("*")).first()
    once = bool(lost) and tuple(done) == (spark.read.parquet(inbox).count(), 6)
    return checkpointing.read_committed(spark, out).select(
        "annotation_id", "is_helpful", "helpfulness_score", "confidence",
        F.array_join("quality_flags", ",").alias("flags"), F.lit(once).alias("once"),
    )


def score_batch(spark: SparkSession, d: str) -> DataFrame:
    """The batch counterpart of the streaming query."""
    return score_rows(v.reviews(spark, d), v.TEST_LEXICON)
