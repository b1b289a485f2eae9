"""Forests and boosted trees on Spark tables, whose nodes never are objects of the driver (M3, M5).

Two passes over the rows turn their vectors into cells of a byte: the first finds each feature's cuts from
quantiles of all rows, the second writes five bits per cell. Trees are then grown by :mod:`trees`:

* The trees of a forest do not depend on each other, so they are dealt to tasks in groups, a group for each
  core. A group gets the bytes as a stream. Beyond ``IN_MEMORY`` bytes they go to the task's scratch disk and
  are mapped, so a task's own memory is some 80 bytes per row, whatever the number of features.
* Each tree of a boosted model depends on those before it. A narrow table is read by one task, at a
  byte per cell, which spares a chain of a thousand short jobs; others are left to Spark ML.

A fitted node has 13 bytes. A model goes to the tasks that score with it as one broadcast of such arrays.
"""

from __future__ import annotations

import json
import math
import tempfile
from collections.abc import Iterator, Mapping
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewsift.models.trees import BINS, Tree, binned, boost, cuts_of, draws_of, grow_classifier, packed_cells, unpacked_cells, walk
from reviewsift.session import materialize

#: Values of a feature that a pass keeps of an Arrow batch: all, or as many quantiles.
POINTS = 512
#: Rows whose numbers are worked on at a time.
ROWS = 2_000
#: Bytes of a task's matrix beyond which it is mapped from the scratch disk.
IN_MEMORY = 32 << 20
#: Groups of a forest's trees at most: each gets its copy of the bytes.
GROUPS = 32
#: A table of up to so many features and cells is boosted by one task.
LOCAL_WIDTH, LOCAL_CELLS = 64, 1 << 25
_SCHEMA = "tree int, feature binary, cut binary, left binary, value binary"


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow batch as a matrix."""
    flat = column.flatten()
    width = len(flat) // len(column) if len(column) else 0
    if column.null_count or flat.null_count or (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError("Every row needs a vector, all of one width")
    return flat.to_numpy().reshape(-1, width)


def feature_cuts(vectors: DataFrame) -> list[np.ndarray]:
    """Cuts of each feature of the array column ``z``, from quantiles of all rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.sort(_matrix(batch.column(0)), axis=0)
            n = len(values)
            kept = min(n, POINTS)
            # Each kept value stands for the rows up to it, so the greatest is among them.
            edges = (np.arange(1, kept + 1) * n) // kept
            weights = np.diff(edges, prepend=0).astype(np.float64).tobytes()
            columns = np.ascontiguousarray(values[edges - 1].T)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(columns), dtype=np.int32)), pa.array([c.tobytes() for c in columns], pa.binary()), pa.array([weights] * len(columns), pa.binary())],
                names=["feature", "points", "weights"],
            )

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for feature, points, weights in zip(*(c.to_pylist() for c in batch.columns)):
                own = held.setdefault(feature, ([], []))
                own[0].append(np.frombuffer(points))
                own[1].append(np.frombuffer(weights))
        for feature, parts in held.items():
            cuts = cuts_of(*(np.concatenate(p) for p in parts))
            yield pa.RecordBatch.from_arrays([pa.array([feature], pa.int32()), pa.array([cuts.tobytes()], pa.binary())], names=["feature", "cuts"])

    points = vectors.select("z").mapInArrow(partial, "feature int, points binary, weights binary")
    found = points.repartition("feature").mapInArrow(combine, "feature int, cuts binary").collect()
    return [np.frombuffer(r["cuts"]) for r in sorted(found, key=lambda r: r["feature"])]


def _bytes(vectors: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """A stored table of id, label, weight and the packed cells of each vector; from ``z``, label, weight."""
    width = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                some = batch.slice(start, ROWS)
                values = _matrix(some.column(0))
                if values.shape[1] != width:
                    raise ValueError("Every row needs a vector, all of one width")
                label, weight = some.column(1), some.column(2)
                if label.null_count or weight.null_count or not np.isin(label.to_numpy(), (0, 1)).all():
                    raise ValueError("Every row needs a label, 0 or 1, and a weight")
                words = packed_cells(binned(values, cuts))
                offsets = np.arange(len(values) + 1, dtype=np.int32) * (2 * words.shape[1])
                cells = pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(words)])
                yield pa.RecordBatch.from_arrays([label, weight, cells], names=["label", "weight", "cells"])

    found = vectors.select("z", "label", "weight").mapInArrow(run, "label int, weight double, cells binary")
    return materialize(found.select(F.monotonically_increasing_id().alias("id"), "label", "weight", "cells"))


def _read(batches: Iterator[pa.RecordBatch], width: int) -> tuple[np.ndarray, ...]:
    """(cells, ids, labels, weights) of all rows of a task; many cells are mapped from a file of its own."""
    columns, parts, size, file = ([], [], []), [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        for held, column, kind in zip(columns, batch.columns, (np.int64, np.uint8, np.float64)):
            held.append(column.to_numpy().astype(kind))
        cells = batch.column(3)
        offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
        words = np.frombuffer(cells.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint16)
        part = unpacked_cells(words.reshape(len(cells), -1), width).reshape(-1)
        size += len(part)
        if file is None and size > IN_MEMORY:
            file = tempfile.TemporaryFile()
            for held in parts:
                file.write(held.data)
            parts = []
        if file is None:
            parts.append(part)
        else:
            file.write(part.data)
    if file is None:
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    else:
        file.flush()
        flat = np.memmap(file, np.uint8, "r")
    return flat.reshape(-1, width), *(np.concatenate(x) if x else np.zeros(0) for x in columns)


def _tree_batch(k: int, tree: Tree) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([p], pa.binary()) for p in tree.packed())], names=["tree", "feature", "cut", "left", "value"])


class TreeModel:
    """Cuts and packed trees. ``score`` is the column of what its trees say of a vector."""

    def __init__(self, cuts: list[np.ndarray], packed: list[tuple[bytes, ...]]) -> None:
        self.cuts, self.packed, self._shared = cuts, packed, None

    def _total(self, vector: str) -> Column:
        """The sum of the trees' values for a vector column."""
        if self._shared is None:
            self._shared = SparkSession.active().sparkContext.broadcast((self.cuts, self.packed))
        shared = self._shared

        @F.arrow_udf("double")
        def total(vectors: pa.Array) -> pa.Array:
            cuts, packed = shared.value
            trees = [Tree.unpacked(p) for p in packed]
            out = np.zeros(len(vectors))
            for start in range(0, len(vectors), ROWS):
                values = _matrix(vectors.slice(start, ROWS))
                if values.shape[1] != len(cuts):
                    raise ValueError(f"The model knows {len(cuts)} features, a row has {values.shape[1]}")
                cells = binned(values, cuts)
                for tree in trees:
                    out[start : start + ROWS] += walk(tree, cells)
            return pa.array(out)

        return total(vector_to_array(vector))

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per tree; the cuts stand in a row numbered -1."""
        cuts = json.dumps([c.tolist() for c in self.cuts]).encode()
        rows = [(-1, cuts, b"", b"", b""), *((k, *p) for k, p in enumerate(self.packed))]
        table = pa.table([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5))], names=["tree", "feature", "cut", "left", "value"])
        spark.createDataFrame(table, _SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        cuts, *packed = _collected(spark.read.schema(_SCHEMA).parquet(path))
        return cls([np.array(c, np.float64) for c in json.loads(cuts[0])], packed)


class Forest(TreeModel):
    """A random forest for labels 0 and 1."""

    @property
    def getNumTrees(self) -> int:  # noqa: N802 - as Spark ML calls it
        return len(self.packed)

    def getCacheNodeIds(self) -> bool:  # noqa: N802 - as Spark ML calls it
        """Rows stay with their node between levels."""
        return True

    def score(self, vector: str) -> Column:
        """The probability of class 1: the mean of the leaves' shares."""
        return self._total(vector) / F.lit(float(len(self.packed)))


class Boosted(TreeModel):
    """Boosted trees for labels 0 and 1."""

    def score(self, vector: str) -> Column:
        """The probability of class 1."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * self._total(vector)))


def _collected(trees: DataFrame) -> list[tuple[bytes, ...]]:
    return [tuple(map(bytes, r[1:])) for r in sorted(trees.collect(), key=lambda r: r["tree"])]


def _vectors(rows: DataFrame, vector: str, weight: Column) -> DataFrame:
    return rows.select(vector_to_array(vector).alias("z"), F.col("label").cast("int").alias("label"), weight.cast("double").alias("weight"))


def fit_forest(
    rows: DataFrame, vector: str, weights: Mapping[int, float], trees: int, depth: int, seed: int, least: int = 2
) -> Forest:
    """A random forest with class weights: rows drawn with replacement for each tree, as many random features
    at each node as the square root of their number, ``BINS`` bins, Gini impurity."""
    ready = _vectors(rows, vector, F.lit(1.0))
    cuts = feature_cuts(ready)
    if not cuts:
        raise ValueError("A forest needs rows")
    table = _bytes(ready, cuts)
    width = len(cuts)
    many = math.ceil(math.sqrt(width)) if trees > 1 else width
    class_weights = tuple(float(weights.get(c, 0.0)) for c in (0, 1))

    groups = min(trees, max(2, min(GROUPS, rows.sparkSession.sparkContext.defaultParallelism)))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        cells, ids, labels, _ = _read(chain([first], batches), width)
        for k in range(first.column(4)[0].as_py(), trees, groups):
            yield _tree_batch(k, grow_classifier(cells, labels, draws_of(ids, seed, k), class_weights, depth, many, np.random.default_rng([seed, k]), least))

    dealt = table.withColumn("group", F.explode(F.array(*[F.lit(g) for g in range(groups)]))).repartitionById(groups, "group")
    return Forest(cuts, _collected(dealt.mapInArrow(grow, _SCHEMA)))


def fit_boosted(
    rows: DataFrame, vector: str, weight: Column, rounds: int, step: float, depth: int, share: float, features: float, seed: int
) -> Boosted:
    """Boosted trees of a narrow table: its bytes are read by one task. Each tree sees a share of the rows
    and a share of the features at each node."""
    ready = _vectors(rows, vector, weight)
    cuts = feature_cuts(ready)
    if not cuts:
        raise ValueError("Boosting needs rows")
    width = len(cuts)
    many = max(1, math.ceil(features * width))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, _, labels, weights = _read(batches, width)
        for k, tree in enumerate(boost(cells, labels, weights, rounds, step, depth, share, many, seed)):
            yield _tree_batch(k, tree)

    return Boosted(cuts, _collected(_bytes(ready, cuts).coalesce(1).mapInArrow(grow, _SCHEMA)))
