"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators' contracts define it: blank and the controls 9 to 13.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session; the number a cluster sets for its input."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and text only, under fixed names, so that clashing extra columns do no harm."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to fewer rows, without empty ones: what is made from them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_texts(df: DataFrame, work, schema: str, columns: list[str]) -> DataFrame:
    """``work(ids, texts)`` over Arrow batches; it returns one list or array per output column.

    ``columns`` names the outputs after ``doc_id``; the schema string describes all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [ids, *(x if isinstance(x, pa.Array) else pa.array(x) for x in work(texts))], names=["doc_id", *columns]
            )

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, decide, text_col: str = "text") -> DataFrame:
    """The rows of a table, all columns, for whose texts ``decide`` (a list to a list of booleans) says yes."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(decide(batch.column(place).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()
