"""Operator 10: shards of nearly equal bytes by sampled splitters.

Method: keys are drawn with a chance in proportion to the bytes of their rows; quantiles of the
sample are the splitters, and records are range-partitioned by them. Ranges that turn out
overfull are sampled again by themselves and subdivided. Running sums inside the ranges, and over
the range totals, then give every record its exact place among all bytes; its shard is the part
of the total in which its middle lies. The law is ``bytes``: sizes per shard are near equal.

The sort key is the digest of the text, then the id: equal texts stand side by side, and a text
that fills a third of the table is still divided by id. A group of equal texts stays in one shard
unless it is larger than ``group_share`` of a shard; a larger one is cut at shard borders.

Edge cases: a null text has no bytes (its size is the overhead, its crc32 that of nothing); rows
with a null id come first in their group; repeated rows get a slot each. With fewer rows than
shards, or one huge row, some shards stay empty. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewsift.llm import common
from reviewsift.session import materialize

SHARDS = 40
OVERHEAD = 16
#: Keys drawn per range; ranges per shard, at least.
DRAWS = 64
RANGES_PER_SHARD = 4
GROUP_SHARE = 0.01
#: A range is overfull beyond so many times its share.
OVERFULL = 1.5


def _splitters(keyed: DataFrame, share: float, draws: int) -> list[str]:
    """Quantiles of a size-weighted sample: one key for every ``share`` bytes, from ``draws`` keys each.

    The sample has as many rows as there are ranges times ``draws``, whatever the input; one task
    sorts it, and the driver gets one key per range.
    """
    expected = F.col("size") * draws / F.lit(float(share))
    times = F.floor(expected) + (F.rand(seed=10) < expected - F.floor(expected)).cast("int")
    drawn = keyed.select("key", times.alias("times")).where("times > 0")
    order = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    ranked = drawn.select("key", "times", F.sum("times").over(order).alias("upto"))
    cut = F.floor(F.col("upto") / draws) > F.floor((F.col("upto") - F.col("times")) / draws)
    return sorted({row["key"] for row in ranked.where(cut).select("key").collect()})


def _ranged(keyed: DataFrame, cuts: list[str]) -> DataFrame:
    """Adds ``range``: how many splitters are not above the key."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([bisect_right(cuts, k) for k in keys], pa.int32())], names=[*batch.schema.names, "range"]
                )

    return keyed.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in keyed.dtypes) + ", range int")


def assign(
    df: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = OVERHEAD,
    group_share: float = GROUP_SHARE,
    draws: int = DRAWS,
) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``slot`` numbers the rows of a shard from 0 without gaps. ``grown_shard`` belongs to the law
    ``key`` and is null.
    """
    docs = common.narrow(df, id_col, text_col)
    text = F.coalesce("text", F.lit(""))
    tail = F.coalesce(F.col("doc_id").cast("decimal(20,0)") + F.lit("9223372036854775809").cast("decimal(20,0)"), F.lit(0))
    group = F.sha2(text, 256)
    keyed = docs.select(
        "doc_id",
        group.alias("text_key"),
        F.concat(group, F.lpad(tail.cast("string"), 20, "0")).alias("key"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    keyed = materialize(keyed)  # freezes the row numbers
    total = keyed.agg(F.sum("size")).first()[0] or 0
    ranges = max(shards * RANGES_PER_SHARD, common.partitions(df))
    share = max(total / ranges, 1.0)
    cuts = _splitters(keyed, share, draws)
    fill = _ranged(keyed, cuts).groupBy("range").agg(F.sum("size").alias("fill")).where(F.col("fill") > OVERFULL * share)
    overfull = [row["range"] for row in fill.select("range").collect()]
    if overfull:
        again = _splitters(_ranged(keyed, cuts).where(F.col("range").isin(overfull)), share / 2, draws)
        cuts = sorted({*cuts, *again})
    placed = _ranged(keyed, cuts)

    inside = Window.partitionBy("range").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.count("*").over(inside))
    totals = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: as many as there are splitters, which the driver holds anyway.
    starts = totals.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    ordered = materialize(
        summed.join(F.broadcast(starts), "range").select(
            "doc_id", "text_key", "size", "text_crc32", (F.col("bytes_before") + F.col("upto") - F.col("size")).alias("start"), (F.col("rows_before") + F.col("nth") - 1).alias("place")
        )
    )
    groups = ordered.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("start").alias("group_start"), F.sum("size").alias("group_size"))
    most = group_share * total / shards
    # Larger groups are at most shards / group_share in number: few enough to go to every task. Their
    # rows are placed one by one and need no join, so no task meets all copies of a text.
    large = F.broadcast(groups.where(F.col("group_size") > most).select("text_key"))
    whole = groups.where((F.col("copies") > 1) & (F.col("group_size") <= most)).drop("copies")
    single = ordered.join(large, "text_key", "left_semi").select("*", *(F.lit(None).cast("long").alias(c) for c in ("group_start", "group_size")))
    joined = ordered.join(large, "text_key", "left_anti").join(whole, "text_key", "left").unionByName(single)
    twice = F.coalesce(2 * F.col("group_start") + F.col("group_size"), 2 * F.col("start") + F.col("size"))
    sharded = joined.withColumn("shard", F.least(F.lit(shards - 1), F.floor(twice * shards / F.lit(float(2 * max(total, 1)))).cast("int")))
    first = sharded.groupBy("shard").agg(F.min("place").alias("first"))
    return sharded.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(common.table(spark, sf_dir, "documents"))
