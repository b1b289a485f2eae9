"""Label requests and responses as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewsift.functions.columns import clip, collapse, nfc, round_even, strip, text_or_empty
from reviewsift.functions.text import canonical_id
from reviewsift.messages import LABEL_INSTRUCTIONS
from reviewsift.operators.ranking import assign_batches
from reviewsift.operators.validate import needs_review
from reviewsift.schemas import ALLOWED_FLAGS, LABEL_COLUMNS, RUBRIC_COLUMNS, RUBRIC_RANGES

# ---------------------------------------------------------------------------
# Batch limits, fence patterns, response schema and label rules.
# ---------------------------------------------------------------------------
MAX_BATCH = 30
FENCE_START = r"^```(?:json)?\s*"
FENCE_END = r"\s*```$"
LABEL_VERSION = "llm_helpfulness_v1"
BORDERLINE_CONFIDENCE = 0.79
RESPONSE_SCHEMA = (
    '{"labels": [{"annotation_id": "MANUAL_00001", "is_helpful": 0, "confidence": 0.9, '
    '"reason": "", "evidence": {"specificity": 0, "product_experience": 0, '
    '"decision_value": 0, "clarity": 1, "noise_penalty": 0}, '
    '"quality_flags": ["generic_only"]}]}'
)
REQUEST_FIELDS = (
    "annotation_id", "review_id", "product_id", "rating", "purchased_int", "title", "content",
)


def _object(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "map<string,variant>")


def explode_responses(
    responses: DataFrame, body: str = "response_text", key: str = "batch_id"
) -> DataFrame:
    """One row per label item of each response body.

    Accepts a fenced body, an object with a `labels` list, a bare list, one label object, or
    a list under another key: of several such lists the first one of the text. A body without labels gives one row with a NULL `item` and the
    `problem` (`invalid_json` or `no_labels`).
    """
    text = strip(text_or_empty(body))
    bare = F.regexp_replace(F.regexp_replace(text, FENCE_START, ""), FENCE_END, "")
    text = F.when(text.startswith("```"), bare).otherwise(text)
    df = responses.withColumn("_text", text).withColumn("_v", F.try_parse_json("_text"))
    v = F.col("_v")
    df = df.withColumn("_fields", _object(v))
    # A variant sorts the names of an object; the text still has them in their order.
    fields = F.transform(F.json_object_keys("_text"), lambda k: F.try_element_at("_fields", k))
    other_lists = F.filter(
        F.transform(fields, lambda f: F.try_variant_get(f, "$", "array<variant>")),
        lambda a: a.isNotNull() & (F.size(a) > 0)
        & F.try_variant_get(F.get(a, F.lit(0)), "$.annotation_id", "variant").isNotNull(),
    )
    single = F.when(
        F.map_contains_key("_fields", "annotation_id"), F.array(v)
    )
    items = F.coalesce(
        F.try_variant_get(v, "$.labels", "array<variant>"),
        F.try_variant_get(v, "$", "array<variant>"),
        single,
        F.get(other_lists, F.lit(0)),
    )
    df = df.withColumn("_items", items)
    problem = F.when(v.isNull(), "invalid_json").when(F.col("_items").isNull(), "no_labels")
    return df.withColumn("problem", problem).select(
        key, "problem", F.posexplode_outer("_items").alias("item_index", "item")
    )


def _checked_int(item: Column, path: str, low: int, high: int) -> Column:
    value = F.try_variant_get(item, path, "int")
    return F.when(value.between(low, high), value)


def parsed_labels(items: DataFrame, key: str = "batch_id") -> DataFrame:
    """Normalise exploded items; `reject_reason` is NULL for good rows."""
    item = F.col("item")
    fields = _object(item)
    points = {
        name: _checked_int(item, f"$.evidence.{name}", low, high)
        for name, (low, high) in RUBRIC_RANGES.items()
    }
    raw_confidence = F.try_variant_get(item, "$.confidence", "double")
    df = items.withColumns(
        {
            **points,
            "annotation_id": canonical_id(F.try_variant_get(item, "$.annotation_id", "string")),
            "_said": _checked_int(item, "$.is_helpful", 0, 1),
            "_given": F.coalesce(
                F.try_variant_get(item, "$.quality_flags", "array<string>"),
                F.array().cast("array<string>"),
            ),
            "_conf": F.when(F.map_contains_key(fields, "confidence"), raw_confidence).otherwise(0.5),
            "_reason": collapse(
                nfc(F.coalesce(F.try_variant_get(item, "$.reason", "string"), F.lit("")))
            ),
            "_has_evidence": _object(item, "$.evidence").isNotNull(),
            "_is_object": fields.isNotNull(),
        }
    )
    rejected = F.coalesce(
        F.col("problem"),
        F.when(~F.col("_is_object"), "not_an_object"),
        F.when(F.col("annotation_id").isNull(), "missing_annotation_id"),
        F.when(~F.col("_has_evidence"), "missing_evidence"),
        *[F.when(F.col(name).isNull(), f"bad_{name}") for name in RUBRIC_COLUMNS],
        F.when(F.col("_said").isNull(), "bad_is_helpful"),
        F.when(F.col("_conf").isNull(), "bad_confidence"),
    )
    df = df.withColumns(
        {
            "reject_reason": rejected,
            "helpfulness_score": sum((F.col(c) for c in RUBRIC_COLUMNS), F.lit(0)),
        }
    )
    score = F.col("helpfulness_score")
    borderline = score.between(2, 3)
    clipped = clip(F.col("_conf"), 0.0, 1.0)
    capped = F.when(borderline, F.least(clipped, F.lit(BORDERLINE_CONFIDENCE))).otherwise(clipped)
    allowed = F.array(*[F.lit(f) for f in ALLOWED_FLAGS])
    flags = F.array_sort(
        F.array_union(
            F.array_intersect("_given", allowed),
            F.when(borderline, F.array(F.lit("ambiguous"))).otherwise(
                F.array().cast("array<string>")
            ),
        )
    )
    df = df.withColumns(
        {
            "is_helpful": F.when(score >= 4, 1).when(score <= 1, 0).otherwise(F.col("_said")),
            "_capped": capped,
            "confidence": round_even(capped, 3),
            "reason": F.col("_reason"),
            "quality_flags": flags,
            "label_version": F.lit(LABEL_VERSION),
            "label_source": F.lit("llm"),
            "adjudicated": F.lit(False),
        }
    ).withColumn("needs_human_review", needs_review(F.col("_capped"), F.col("quality_flags")))
    return df.select(key, "item_index", "reject_reason", "annotation_id", *LABEL_COLUMNS)


def normalize_labels(items: DataFrame, key: str = "batch_id") -> tuple[DataFrame, DataFrame]:
    """(labels, rejects); rejects carry the batch, item position and reason."""
    parsed = parsed_labels(items, key)
    good = parsed.filter(F.col("reject_reason").isNull()).drop("reject_reason", "item_index")
    bad = parsed.filter(F.col("reject_reason").isNotNull()).select(
        key, "item_index", "annotation_id", "reject_reason"
    )
    return good, bad


def label_requests(
    df: DataFrame,
    n: int,
    order: list[Column],
    instructions: str = LABEL_INSTRUCTIONS,
    schema: str = RESPONSE_SCHEMA,
    fields: tuple[str, ...] = REQUEST_FIELDS,
) -> DataFrame:
    """One request per batch of n records: record count, records as JSON, and prompt."""
    if not 1 <= n <= MAX_BATCH:
        raise ValueError(f"A request holds 1..{MAX_BATCH} records")
    batched = assign_batches(df, n, order)
    record = F.struct(F.col("batch_position"), F.struct(*fields).alias("record"))
    # A batch holds at most n <= MAX_BATCH rows by construction.
    requests = batched.groupBy("batch_id").agg(
        F.count("*").alias("n_records"),
        F.to_json(
            F.transform(F.array_sort(F.collect_list(record)), lambda r: r["record"])
        ).alias("records"),
    )
    prompt = F.concat_ws(
        "\n", F.lit(instructions), F.col("records"), F.col("n_records").cast("string"), F.lit(schema)
    )
    return requests.withColumn("prompt", prompt)


def batch_status(requests: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per batch: whether every item parsed and the id sets are equal (`batch_ok`).

    ``requests`` has `batch_id` and `annotation_id`; ``parsed`` comes from
    :func:`parsed_labels`. One bad item fails its whole batch.
    """
    asked = requests.select("batch_id", "annotation_id").distinct().withColumn("asked", F.lit(1))
    given = parsed.groupBy("batch_id", "annotation_id").agg(
        F.count_if(F.col("reject_reason").isNotNull()).alias("rejected")
    ).withColumn("given", F.lit(1))
    joined = asked.alias("a").join(
        given.alias("g"),
        (F.col("a.batch_id") == F.col("g.batch_id"))
        & F.col("a.annotation_id").eqNullSafe(F.col("g.annotation_id")),
        "full_outer",
    )
    per_batch = joined.groupBy(
        F.coalesce(F.col("a.batch_id"), F.col("g.batch_id")).alias("batch_id")
    ).agg(
        F.count("asked").alias("requested"),
        F.count_if(F.col("given").isNull()).alias("missing"),
        F.count_if(F.col("asked").isNull()).alias("extra"),
        F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"),
    )
    return per_batch.withColumn(
        "batch_ok", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("rejected") == 0)
    )


def retry_requests(requests: DataFrame, status: DataFrame) -> DataFrame:
    """Rows of failed batches as new single-row batches.

    A failed batch that held one row only is not retried again: it comes back with
    `exhausted` true and keeps its batch id.
    """
    failed = status.filter(~F.col("batch_ok") & (F.col("requested") > 0)).select(
        "batch_id", "requested"
    )
    rows = requests.join(failed, "batch_id", "inner")
    exhausted = F.col("requested") == 1
    retry_id = F.when(exhausted, F.col("batch_id").cast("string")).otherwise(
        F.concat_ws("/", F.col("batch_id").cast("string"), F.col("annotation_id"))
    )
    return rows.withColumns({"exhausted": exhausted, "retry_batch_id": retry_id}).drop("requested")
