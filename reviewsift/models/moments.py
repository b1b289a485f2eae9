"""Leave-fold-out linear models from one pass over the rows.

Counts, means and co-moments of a set of rows combine: the whole is the sum of its folds, and the rows
outside a fold are the whole minus the fold. One pass therefore gives the standardisation, the class
weights and the ridge regressions of every split. Moments are kept around their own means
and combined with the usual correction for the distance between means, so large offsets in
a column cost no digits.

Tasks sum their rows by fold with matrix products, one Arrow batch at a time; matrix rows are then
combined on the executors. The driver gets one matrix per fold, whose size depends on the number of
columns alone, and solves the normal equations of each split.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegressionModel
from pyspark.ml.util import Identifiable
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Moments:
    """Count, means and co-moments (sums of products of centred values) of a set of rows."""

    names: tuple[str, ...]
    n: float
    mean: np.ndarray
    products: np.ndarray

    def plus(self, other: Moments) -> Moments:
        return self._combined(other, 1.0)

    def minus(self, part: Moments) -> Moments:
        """Moments of the rows that are not in ``part``, a subset of these."""
        return self._combined(part, -1.0)

    def _combined(self, other: Moments, sign: float) -> Moments:
        n = self.n + sign * other.n
        if n <= 0:
            return empty(self.names)
        if other.n == 0:
            return self
        away = other.mean - self.mean
        mean = self.mean + sign * away * (other.n / n)
        moved = np.outer(away, away) * (sign * self.n * other.n / n)
        return Moments(self.names, n, mean, self.products + sign * other.products + moved)

    def place(self, name: str) -> int:
        return self.names.index(name)

    def deviation(self, name: str) -> float:
        """Population deviation; 0 without rows."""
        i = self.place(name)
        return float(np.sqrt(max(self.products[i, i], 0.0) / self.n)) if self.n else 0.0

    def average(self, name: str) -> float:
        return float(self.mean[self.place(name)])


def empty(names: Sequence[str]) -> Moments:
    return Moments(tuple(names), 0.0, np.zeros(len(names)), np.zeros((len(names), len(names))))


def _of(values: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    mean = values.mean(0)
    centred = values - mean
    return float(len(values)), mean, centred.T @ centred


def _joined(a, b):
    """The merged (count, mean, products); products may be some rows of the matrix, at ``a[3]``."""
    n = a[0] + b[0]
    away = b[1] - a[1]
    moved = np.outer(away if len(a) < 4 else away[a[3]], away) * (a[0] * b[0] / n)
    return (n, a[1] + away * (b[0] / n), a[2] + b[2] + moved, *a[3:])


def fold_moments(
    rows: DataFrame, columns: Mapping[str, Column], fold: str | None = None, vector: tuple[str, Column, int] | None = None
) -> dict[int, Moments]:
    """Moments of the named columns, and of a vector's cells, per value of ``fold`` (0 without one).

    ``vector`` is (prefix, array column, width); its cells are named prefix0, prefix1, ... and come
    first. Rows whose fold is NULL are left out; a NULL or non-finite number makes the pass fail,
    because it has no place in a normal equation. The pass fails for a vector of another width, too.
    """
    prefix, cells, width = vector or ("", F.array().cast("array<double>"), 0)
    names = (*[f"{prefix}{i}" for i in range(width)], *columns)
    size = len(names)
    numbers = F.array(*[c.cast("double") for c in columns.values()]) if columns else F.array().cast("array<double>")
    key = F.lit(0) if fold is None else F.col(fold).cast("int")
    narrow = rows.select(key.alias("fold"), F.concat(cells, numbers).alias("z")).where("fold is not null")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            folds = batch.column(0).to_numpy()
            flat = batch.column(1).flatten()
            if flat.null_count or len(flat) != batch.num_rows * size:
                raise ValueError(f"Every row needs {size} numbers")
            values = flat.to_numpy().reshape(-1, size)
            if not np.isfinite(values).all():
                raise ValueError("Moments need finite numbers")
            for f in np.unique(folds):
                found = _of(values[folds == f])
                held[int(f)] = _joined(held[int(f)], found) if int(f) in held else found
        for f, (n, mean, products) in held.items():
            yield _matrix_rows(f, n, mean, products, np.arange(size))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            for f, i, n, mean, products in zip(*(batch.column(k).to_pylist() for k in range(3)), *(_arrays(batch.column(k)) for k in (3, 4))):
                found = (n, mean, products[None, :], np.array([i]))
                held[f, i] = _joined(held[f, i], found) if (f, i) in held else found
        for (f, _), (n, mean, products, at) in held.items():
            yield _matrix_rows(f, n, mean, products, at)

    schema = "fold int, place int, n double, mean array<double>, products array<double>"
    parts = narrow.mapInArrow(partial, schema).repartition("fold", "place").mapInArrow(combine, schema)
    found: dict[int, Moments] = {}
    for row in parts.toLocalIterator():
        made = found.setdefault(row["fold"], empty(names))
        if made.n == 0:
            made = found[row["fold"]] = Moments(names, row["n"], np.array(row["mean"]), made.products)
        made.products[row["place"]] = row["products"]
    # Matrix rows come from different tasks: equal up to rounding, and symmetric after this.
    return {f: Moments(names, m.n, m.mean, (m.products + m.products.T) / 2) for f, m in sorted(found.items())}


def _arrays(column: pa.Array) -> list[np.ndarray]:
    flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[s:e] for s, e in zip(offsets[:-1], offsets[1:])]


def _matrix_rows(f: int, n: float, mean: np.ndarray, products: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    many = len(places)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(many, f, np.int32)),
            pa.array(places.astype(np.int32)),
            pa.array(np.full(many, n)),
            pa.array([mean] * many, pa.list_(pa.float64())),
            pa.array(list(products), pa.list_(pa.float64())),
        ],
        names=["fold", "place", "n", "mean", "products"],
    )


def total(parts: Mapping[int, Moments]) -> Moments:
    """Moments of all folds together."""
    values = list(parts.values())
    whole = values[0]
    for part in values[1:]:
        whole = whole.plus(part)
    return whole


def leave_out(parts: Mapping[int, Moments]) -> dict[int, Moments]:
    """For each fold the moments of all other folds."""
    whole = total(parts)
    return {f: whole.minus(part) for f, part in parts.items()}


def scaler_of(moments: Moments, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """M8: mean and population deviation per column; a constant column keeps scale 1."""
    return {c: (moments.average(c), moments.deviation(c) or 1.0) for c in columns}


def balanced_weights(moments: Moments, label: str = "label") -> dict[int, float]:
    """M9 for a 0/1 label: n / (k * n_c) over the classes that occur."""
    ones = round(moments.average(label) * moments.n)
    counts = {c: n for c, n in ((0, round(moments.n) - ones), (1, ones)) if n}
    return {c: moments.n / (len(counts) * n) for c, n in counts.items()}


def ridge_solution(
    moments: Moments, features: Sequence[str], target: str, alpha: float, scaler: Mapping[str, tuple[float, float]] | None = None
) -> tuple[np.ndarray, float]:
    """M7: (coefficients, intercept) that minimise the squared error plus ``alpha`` times their squares.

    Columns of ``scaler`` count as standardised by it; the intercept is not penalised.
    """
    scaler = scaler or {}
    at = [moments.place(c) for c in features]
    centre = np.array([scaler.get(c, (0.0, 1.0))[0] for c in features])
    scale = np.array([scaler.get(c, (0.0, 1.0))[1] for c in features])
    gram = moments.products[np.ix_(at, at)] / np.outer(scale, scale)
    cross = moments.products[at, moments.place(target)] / scale
    beta = np.linalg.solve(gram + alpha * np.eye(len(at)), cross)
    means = (moments.mean[at] - centre) / scale
    return beta, moments.average(target) - float(means @ beta)


def linear_model(coefficients: Sequence[float], intercept: float, features: str, prediction: str) -> LinearRegressionModel:
    """A Spark ML model with given coefficients, which scores, saves and loads as a fitted one."""
    spark = SparkSession.active()
    context = spark.sparkContext
    made = context._jvm.org.apache.spark.ml.regression.LinearRegressionModel(
        f"linReg_{Identifiable()._randomUID()}", _py2java(context, Vectors.dense(list(map(float, coefficients)))), float(intercept)
    )
    model = LinearRegressionModel(made)
    return model.setFeaturesCol(features).setPredictionCol(prediction)


def oof_ridge(
    rows: DataFrame, features: Sequence[str], target: str, fold: str, alpha: float, output: str = "oof_prediction"
) -> tuple[DataFrame, dict[int, tuple[np.ndarray, float]]]:
    """Every row scored by the ridge regression of the other folds; also those models by fold.

    One pass over the rows fits all of them. Rows of the only fold, which nothing else can score,
    get NULL.
    """
    parts = fold_moments(rows, {c: F.col(c) for c in (*features, target)}, fold)
    models = {f: ridge_solution(m, features, target, alpha) for f, m in leave_out(parts).items() if m.n} if parts else {}
    scored = F.lit(None).cast("double")
    for f, (beta, intercept) in models.items():
        value = F.lit(intercept)
        for c, b in zip(features, beta):
            value = value + F.col(c).cast("double") * F.lit(float(b))
        scored = F.when(F.col(fold) == f, value).otherwise(scored)
    return rows.withColumn(output, scored), models
