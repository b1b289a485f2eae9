"""Dataset manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def manifest(
    df: DataFrame,
    target: str = "help",
    sources: dict[str, DataFrame] | None = None,
    keys: Sequence[str] = (),
    optional_columns: Sequence[str] = (),
    source_columns: Sequence[str] = (),
) -> DataFrame:
    """One row describing a produced table.

    Row counts of the sources and of the output, columns, merge keys, the target distribution
    as a map, optional columns the source lacked, and source columns that were removed.
    """
    spark = df.sparkSession
    levels = df.groupBy(F.col(target).cast("string").alias("value")).agg(F.count("*").alias("n"))
    result = levels.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("output_rows"),
        F.map_from_entries(
            F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "n"))))
        ).alias("target_distribution"),
    )
    for name, source in (sources or {}).items():
        result = result.withColumn(f"{name}_rows", source.agg(F.count("*")).scalar())
    missing = [c for c in optional_columns if source_columns and c not in source_columns]
    removed = [c for c in source_columns if c not in df.columns]

    def names(values):
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return result.withColumns(
        {
            "columns": names(df.columns),
            "merge_keys": names(keys),
            "target_column": F.lit(target),
            "empty_columns": names(missing),
            "removed_columns": names(removed),
        }
    )
