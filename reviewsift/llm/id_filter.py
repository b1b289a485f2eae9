"""A bitmap of fixed size that tells most rows that a later join needs nothing of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap: 128 KiB, whatever the input.
BITS = 1 << 20


def slot(column: str):
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(BITS))


def bitmap(ids: DataFrame, column: str) -> bytes:
    """Bits of the ids' hash slots, put together on the executors by 64-bit words; at most
    ``BITS / 64`` rows come to the driver."""
    words = (
        ids.select(slot(column).alias("slot"))
        .groupBy((F.col("slot") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
        .collect()
    )
    made = np.zeros(BITS // 64, np.int64)
    for row in words:
        made[row["word"]] = row["bits"]
    return made.tobytes()


def keep_likely(df: DataFrame, column: str, ids: DataFrame, ids_column: str) -> DataFrame:
    """Rows whose id may be among ``ids``: none of those is lost, some others stay. The exact
    join comes after it; with very many ids the bitmap fills up and merely passes rows on."""
    bits = bitmap(ids, ids_column)
    columns = df.columns

    def run(batches):
        table = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        for batch in batches:
            if batch.num_rows:
                hit = table[batch.column(len(columns)).to_numpy(zero_copy_only=False)].astype(bool)
                if hit.any():
                    kept = batch.filter(pa.array(hit))
                    yield kept.select(list(range(len(columns))))

    return df.withColumn("_slot", slot(column)).mapInArrow(run, df.schema)


__all__ = ["bitmap", "keep_likely"]
