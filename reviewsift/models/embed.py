"""Text embeddings (M1, M2)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F, types as T

from reviewsift.functions.columns import text_or_empty

# ---------------------------------------------------------------------------
# N-gram lengths, embedding width and encoder limits.
# ---------------------------------------------------------------------------
NGRAM_SIZES = (3, 4, 5)
HASH_DIMENSION = 384
ENCODER_BATCH = 32
ENCODER_MAX_LENGTH = 192
ENCODERS_KEPT = 4
_MULTIPLIER = np.uint64(1_099_511_628_211)
_MIXER = np.uint64(0x9E3779B97F4A7C15)


def hash_vector(
    text: str, dimension: int, normalize: bool = True, sizes: tuple[int, ...] = NGRAM_SIZES
) -> np.ndarray:
    """Hashed counts of the character n-grams inside words padded with a blank on each side.

    In a text with single blanks these are the overlapping windows whose inner characters are
    not blank, so all windows of one length are hashed at once.
    """
    counts = np.zeros(dimension, dtype=np.float64)
    padded = f" {' '.join(text.lower().split())} "
    points = np.frombuffer(padded.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    blank = points == ord(" ")
    for n in sizes:
        windows = len(points) - n + 1
        if windows < 1:
            continue
        hashed = np.zeros(windows, dtype=np.uint64)
        inside = np.ones(windows, dtype=bool)
        for k in range(n):
            hashed = hashed * _MULTIPLIER + points[k : k + windows]
            if 0 < k < n - 1:
                inside &= ~blank[k : k + windows]
        hashed = (hashed ^ (hashed >> np.uint64(32))) * _MIXER
        buckets = (hashed >> np.uint64(33)) % np.uint64(dimension)
        counts += np.bincount(buckets[inside].astype(np.int64), minlength=dimension)
    length = np.sqrt((counts * counts).sum())
    return (counts / length if normalize and length else counts).astype(np.float32)


def list_array(vectors: np.ndarray) -> pa.Array:
    """The rows of a matrix as Arrow lists, without an object for each."""
    rows, width = vectors.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(rows + 1, dtype=np.int32) * width, pa.int32()),
        pa.array(np.ascontiguousarray(vectors, dtype=np.float32).reshape(-1)),
    )


def hash_embed(
    df: DataFrame,
    column: str,
    dimension: int = HASH_DIMENSION,
    output: str = "embedding",
    normalize: bool = True,
) -> DataFrame:
    """M1: hashed character n-gram counts with unit length, in Arrow batches.

    A text has thousands of n-grams; hashing them as number arrays avoids one string each.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pa.Array) -> pa.Array:
        vectors = np.empty((len(texts), dimension), dtype=np.float32)
        for at, text in enumerate(texts):
            vectors[at] = hash_vector(text.as_py(), dimension, normalize)
        return list_array(vectors)

    vector = array_to_vector(embed(text_or_empty(column)).cast("array<double>"))
    return df.withColumn(output, vector)


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Average token vectors over unmasked tokens; for use inside encoder factories."""
    weights = mask[..., None].astype(hidden.dtype)
    return (hidden * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), 1e-9)


_encoders: dict[str, Callable[[np.ndarray], np.ndarray]] = {}


def _encoder(name: str, make: Callable) -> Callable[[np.ndarray], np.ndarray]:
    """The worker's encoder, made once; a worker keeps the last few."""
    if name not in _encoders:
        while len(_encoders) >= ENCODERS_KEPT:
            del _encoders[next(iter(_encoders))]
        _encoders[name] = make()
    return _encoders[name]


def encode(
    df: DataFrame,
    column: str,
    make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]],
    output: str = "embedding",
    batch_size: int = ENCODER_BATCH,
) -> DataFrame:
    """M2: embeddings from a user-supplied encoder.

    ``make_encoder`` runs once per Python worker and returns a function from an array of texts
    to a matrix. Only ``batch_size`` texts of an Arrow batch are Python strings at a time.
    """
    name = uuid.uuid4().hex

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def udf(texts: pa.Array) -> pa.Array:
        encoder = _encoder(name, make_encoder)
        parts = []
        for at in range(0, len(texts), batch_size):
            given = np.array(texts.slice(at, batch_size).to_pylist(), dtype=object)
            vectors = np.asarray(encoder(given))
            if vectors.ndim != 2 or len(vectors) != len(given):
                raise ValueError(f"An encoder of {len(given)} texts returned an array of {vectors.shape}")
            parts.append(list_array(vectors))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    return df.withColumn(output, udf(F.col(column)))


def encode_cached(
    df: DataFrame,
    key: str,
    column: str,
    make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]],
    cache_path: str,
    batch_size: int = ENCODER_BATCH,
) -> DataFrame:
    """M2 with a cache table keyed by id and text digest: only new rows are encoded.

    The new vectors are appended to the cache, then the whole table is joined from it.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_digest", F.md5(F.col(column)))
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("_digest", T.StringType()),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
        ]
    )
    spark.createDataFrame([], schema).write.mode("append").parquet(cache_path)
    known = spark.read.schema(schema).parquet(cache_path)
    fresh = keyed.join(known.select(key, "_digest"), [key, "_digest"], "left_anti")
    encoded = encode(fresh, column, make_encoder, "embedding", batch_size)
    encoded.select(key, "_digest", "embedding").write.mode("append").parquet(cache_path)
    # A new reader, because a parquet relation lists its files once.
    cached = spark.read.schema(schema).parquet(cache_path).dropDuplicates([key, "_digest"])
    return keyed.join(cached, [key, "_digest"], "left").drop("_digest")
