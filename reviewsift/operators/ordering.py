"""Global order without a single-partition window.

Rows are range-partitioned and sorted, the place of each row is frozen in a table in the
shared folder, and only per-partition totals (one row per partition and group) are summed to
get offsets. A group that holds a third of all rows is spread over many partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reviewsift.session import materialize

#: Low bits of a monotonically increasing id that count rows inside a partition.
ROW_BITS = 33


def _placed(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    keys = [F.col(b) for b in by] + list(order)
    return materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_slot", ROW_BITS))
    )


def _join_chunks(placed: DataFrame, chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join per-(partition, group) values back; the partition number splits hot groups."""
    named = chunks.withColumnsRenamed({b: f"_g_{b}" for b in by}).withColumnRenamed("_part", "_g_part")
    condition = F.col("_part") == F.col("_g_part")
    for b in by:
        condition = condition & F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    dropped = ["_g_part", *[f"_g_{b}" for b in by]]
    # Without groups there is one row per partition, so broadcasting is bounded.
    right = named if by else F.broadcast(named)
    return placed.join(right, condition, "inner").drop(*dropped)


def with_position(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    output: str = "position",
    start: int = 0,
    total: str | None = None,
) -> DataFrame:
    """Number the rows of the table, or of each group, in the given total order.

    ``total`` names a column for the group size, which comes from the same totals.
    """
    placed = _placed(df, by, order)
    chunks = placed.groupBy("_part", *by).agg(
        F.min("_slot").alias("_first"), F.count("*").alias("_rows")
    )
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    if total is not None:
        chunks = chunks.withColumn(total, F.sum("_rows").over(W.partitionBy(*by)))
    return (
        _join_chunks(placed, chunks.drop("_rows"), by)
        .withColumn(output, F.col("_slot") - F.col("_first") + F.col("_before") + F.lit(start))
        .drop("_slot", "_part", "_first", "_before")
    )


def with_running_sums(
    df: DataFrame,
    order: Sequence[Column],
    sums: dict[str, Column],
    by: Sequence[str] = (),
    totals_as: dict[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums per group in a total order; keys are output names.

    ``totals_as`` maps a sum to a column for its group total, which comes with the offsets.
    ``df`` is read twice (range boundaries are sampled first), so it should be a stored table.
    """
    totals_as = totals_as or {}
    placed = _placed(df.withColumns({f"_w_{n}": w for n, w in sums.items()}), by, order)
    totals = placed.groupBy("_part", *by).agg(
        *[F.sum(f"_w_{n}").alias(f"_t_{n}") for n in sums]
    )
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        "_part",
        *by,
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(W.partitionBy(*by)).alias(out) for n, out in totals_as.items()],
    )
    # One partition's share of one group: never more rows than a range partition holds.
    local = W.partitionBy("_part", *by).orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)
    summed = placed.withColumns({f"_l_{n}": F.sum(f"_w_{n}").over(local) for n in sums})
    joined = _join_chunks(summed, totals, by)
    joined = joined.withColumns({n: F.col(f"_l_{n}") + F.col(f"_b_{n}") for n in sums})
    drop = ["_slot", "_part"] + [f"_{k}_{n}" for n in sums for k in "wlb"]
    return joined.drop(*drop)
