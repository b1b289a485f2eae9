"""Ranking, sampling, folds and batching (W1-W5) and work slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reviewsift.operators.ordering import ROW_BITS, with_position


def rank_reviews(
    df: DataFrame,
    partition_by: Sequence[str] = (),
    score: str = "helpfulness_score",
    index: str = "original_index",
) -> DataFrame:
    """Rank by score descending, ties in input order, from 1; `count` is the group size."""
    order = [F.col(score).desc_nulls_last(), F.col(index)]
    return with_position(df, order, partition_by, "rank", start=1, total="count")


def _first_of_tasks(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each partition: no other can be among the first k of the table."""
    inside = F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1)
    return df.sortWithinPartitions(*order).withColumn("_place", inside).filter(F.col("_place") < k).drop("_place")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows per group.

    Every task keeps only its own k best rows per group before the shuffle, so a hot group
    never travels whole. Without groups the tasks' first k rows are cut by their global
    position: k may be anything, and no task gathers k rows.
    """
    if not by:
        first = _first_of_tasks(df, order, k)
        return with_position(first, order, output="rank", start=1).filter(F.col("rank") <= k)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(
        F.col("rank") <= k
    )


def _hash_order(seed: int, key: str) -> list[Column]:
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]


def sample_per_group(
    df: DataFrame, by: Sequence[str], n: int, seed: int = 42, key: str = "review_id"
) -> DataFrame:
    """N seeded rows per group (or overall): the n smallest digests of seed and key."""
    return top_k(df, by, _hash_order(seed, key), n).drop("rank")


def stratified_folds(
    df: DataFrame,
    label: str,
    k: int,
    seed: int = 42,
    key: str = "annotation_id",
    output: str = "fold",
) -> DataFrame:
    """Folds 0..k-1 whose label counts differ by at most one row, deterministic by seed."""
    digest, tie = _hash_order(seed, key)
    placed = with_position(df.withColumn("_hash", digest), [F.col("_hash"), tie], [label], "_position")
    return placed.withColumn(output, (F.col("_position") % k).cast("int")).drop(
        "_position", "_hash"
    )


def assign_batches(
    df: DataFrame, n: int, order: Sequence[Column], output: str = "batch_id"
) -> DataFrame:
    """Consecutive batches of exactly n rows; `batch_position` counts inside a batch."""
    if n < 1:
        raise ValueError("A batch holds at least one row")
    placed = with_position(df, order, output="_position")
    return placed.withColumns(
        {
            output: F.floor(F.col("_position") / n),
            "batch_position": (F.col("_position") % n).cast("int"),
        }
    ).drop("_position")


def work_slice(
    df: DataFrame, start: int, limit: int | None, order: Sequence[Column]
) -> DataFrame:
    """Rows start..start+limit in a stable order, cut by global position, because a plain
    limit gathers its rows in one task. Rows that come after the slice in their own task go first."""
    inside = F.col("_position") >= start
    if limit is not None:
        inside = inside & (F.col("_position") < start + limit)
        df = _first_of_tasks(df, order, start + limit)
    return with_position(df, order, output="_position").filter(inside).drop("_position")
