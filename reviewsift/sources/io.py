"""Readers, writers and column contracts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from reviewsift.functions.columns import text_or_empty, word_count
from reviewsift.functions.text import join_title
from reviewsift.schemas import CHECKPOINT, RAW_REVIEWS
from reviewsift.sources.csv_records import CSV_OPTIONS, read_csv


def read_reviews(
    spark: SparkSession, path: str, schema: T.StructType = RAW_REVIEWS, fmt: str | None = None
) -> DataFrame:
    """Typed scan of reviews, CSV or parquet by path suffix (or ``fmt``).

    Columns are found by name whatever their order and must all be there; values of another type
    are cast with the given schema (bad values become NULL). Quoted CSV fields may span lines; a file
    is read by as many tasks as it has ranges all the same.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    if fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        raw = read_csv(spark, path).drop("_file")
        raw = raw.withColumnsRenamed({raw.columns[0]: raw.columns[0].lstrip("\ufeff")})
    require_columns(raw, schema.names)
    given = {f.name: f.dataType for f in raw.schema.fields}
    casts = {
        f.name: F.col(f.name).try_cast(f.dataType) for f in schema.fields if given[f.name] != f.dataType
    }
    return raw.withColumns(casts) if casts else raw


def spread(df: DataFrame) -> DataFrame:
    """Deal out a table of fewer files than cores before CPU-heavy work.

    A table in a single file may be one row group, hence one task, so its rows are dealt out once,
    texts included. Tables of as many files as cores are left alone.
    """
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= parallelism else df.repartition(parallelism)


def read_batches(
    spark: SparkSession, directory: str, schema: T.StructType | None = None, fmt: str = "csv"
) -> DataFrame:
    """Every batch file of a directory in one scan, with `source_file`."""
    reader = spark.read.options(pathGlobFilter=f"*.{fmt}")
    if fmt == "csv":
        scan = reader.options(**CSV_OPTIONS).csv(directory)
    else:
        scan = reader.format(fmt).load(directory)
    scan = scan.withColumn("source_file", F.col("_metadata.file_name"))
    if schema is None:
        return scan
    require_columns(scan, schema.names)
    casts = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema.fields}
    return scan.withColumns(casts).select(*schema.names, "source_file")


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """S3: fail while planning when columns are missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


# Typed defaults of optional batch columns.
OPTIONAL_DEFAULTS: dict[str, tuple[str, object]] = {
    "review_id": ("string", ""),
    "product_id": ("string", ""),
    "user_id": ("string", ""),
    "rating": ("int", 0),
    "purchased_int": ("int", 0),
    "sample_group": ("string", ""),
    "title": ("string", ""),
    "content": ("string", ""),
}


def with_defaults(
    df: DataFrame, defaults: Mapping[str, tuple[str, object]] = OPTIONAL_DEFAULTS
) -> DataFrame:
    """Add absent optional columns and compute missing ids, texts and word counts.

    A missing annotation id is a hash of the content, so it does not depend on row order.
    """
    filled = {}
    for name, (dtype, default) in defaults.items():
        if name not in df.columns:
            filled[name] = F.lit(default).cast(dtype)
        elif dtype == "int":
            filled[name] = F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)).cast(dtype)
    df = df.withColumns(filled) if filled else df
    if "review_text" not in df.columns:
        df = df.withColumn("review_text", join_title("title", "content"))
    computed = word_count(text_or_empty("review_text"))
    if "word_count" in df.columns:
        stored = F.col("word_count").try_cast("double").cast("int")
        df = df.withColumn("word_count", F.coalesce(stored, computed))
    else:
        df = df.withColumn("word_count", computed)
    if "annotation_id" not in df.columns:
        identity = F.sha2(
            F.to_json(F.struct("review_id", "product_id", "user_id", "title", "content")), 256
        )
        df = df.withColumn("annotation_id", F.concat(F.lit("ROW_"), identity))
    return df.withColumn("annotation_id", F.col("annotation_id").cast("string"))


def latest_labels(df: DataFrame) -> DataFrame:
    """The last label per annotation id, by `batch_seq`.

    An aggregate, not a window: partial results are combined before the shuffle, so an id
    with very many copies stays cheap. Copies of one batch are told apart by their content.
    """
    values = [c for c in df.columns if c != "annotation_id"]
    row = F.struct(*values)
    order = F.struct(F.col("batch_seq"), F.xxhash64(*values))
    return (
        df.groupBy("annotation_id")
        .agg(F.max_by(row, order).alias("_last"))
        .select("annotation_id", "_last.*")
    )


def read_checkpoint(spark: SparkSession, directory: str, fmt: str = "json") -> DataFrame:
    """Label checkpoint where the last line per annotation id wins."""
    reader = spark.read.schema(CHECKPOINT)
    lines = reader.json(directory) if fmt == "json" else reader.format(fmt).load(directory)
    return latest_labels(lines.filter(F.col("annotation_id").isNotNull()))


def append_checkpoint(
    labels: DataFrame, directory: str, batch_seq: int, fmt: str = "json"
) -> None:
    """Append one batch of labels."""
    names = [f.name for f in CHECKPOINT.fields]
    batch = labels.withColumn("batch_seq", F.lit(batch_seq).cast("long"))
    batch.select(*names).write.mode("append").format(fmt).save(directory)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Table sink; CSV gets a header and arrays as JSON text."""
    if fmt != "csv":
        df.write.mode(mode).format(fmt).save(path)
        return
    nested = {
        f.name: F.to_json(f.name)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
    }
    df.withColumns(nested).write.mode(mode).option("escape", '"').csv(path, header=True)
