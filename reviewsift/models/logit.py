"""Logistic regression by Newton's method (M6): a dozen passes over the rows instead of some hundred.

A pass gives the loss, its slope and its curvature. Tasks sum them over their rows, a block at a time; matrix
rows are then summed on the executors, and the driver solves a system whose size depends on the number of
columns alone. A small table is read by one task, which makes all passes itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import Identifiable
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewsift.session import materialize

#: Cells (eight bytes each) of a table that one task solves.
LOCAL_CELLS = 1 << 23
#: Tasks of a pass: each sends a matrix.
TASKS = 64
_ROWS = 2_048

#: Row 0 of what a pass sums holds the loss and the slope, the others the curvature.
Pass = Callable[[np.ndarray], np.ndarray]


def curvature(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Loss, slope and curvature of the weighted logistic loss over a block of rows; the last column of
    ``beta`` is the intercept."""
    some = np.hstack([x, np.ones((len(x), 1))])
    z = some @ beta
    p = 0.5 * (1.0 + np.tanh(0.5 * z))
    out = np.zeros((len(beta) + 1, len(beta) + 1))
    out[0, 0] = w @ np.logaddexp(0.0, np.where(y == 1, -z, z))
    out[0, 1:] = (w * (p - y)) @ some
    out[1:, 1:] = (some * (w * p * (1.0 - p))[:, None]).T @ some
    return out


def spread_of(x: np.ndarray, y: np.ndarray, w: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Sums for the variances of a block's columns: weights, their squares, and powers of ``x - near``."""
    away = x - near
    out = np.zeros((3, max(2, x.shape[1])))
    out[0, 0], out[0, 1] = w.sum(), w @ w
    out[1, : x.shape[1]], out[2, : x.shape[1]] = w @ away, w @ (away * away)
    return out


def newton(run: Pass, penalty: np.ndarray, iterations: int, close: float = 1e-12) -> np.ndarray:
    """The coefficients that minimise the loss of ``run`` plus half their penalised squares."""

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        found = run(beta)
        return found[0, 0] + 0.5 * penalty @ (beta * beta), found[0, 1:] + penalty * beta, found[1:, 1:] + np.diag(penalty)

    beta = np.zeros(len(penalty))
    now, slope, bend = at(beta)
    for _ in range(iterations):
        step = np.linalg.solve(bend, slope) if np.linalg.cond(bend) < 1e14 else np.linalg.lstsq(bend, slope)[0]
        gain, size = float(slope @ step), 1.0
        if not gain > close * (1.0 + abs(now)):
            break
        found = at(beta - step)
        while found[0] > now - 1e-4 * size * gain and size > 1e-6:
            size /= 2.0
            found = at(beta - size * step)
        if found[0] >= now:
            break
        beta = beta - size * step
        now, slope, bend = found
    return beta


def solve(run: Callable[[Callable, np.ndarray], np.ndarray], near: np.ndarray, standardize: bool, iterations: int) -> np.ndarray:
    """Coefficients, the intercept last. ``run(work, value)`` sums ``work(x, y, w, value)`` over blocks of
    rows. ``standardize`` penalises at the scale of the standardised columns. A constant column
    (always ``near``) gets 0, the intercept is not penalised."""
    sums = run(spread_of, near)
    total, squares = sums[0, :2]
    first, second = sums[1, : len(near)], sums[2, : len(near)]
    variance = np.maximum(second - first * first / total, 0.0) / max(total - squares / total, 1e-300)
    moves = second > 0
    penalty = np.append(np.where(moves & standardize, variance, 1.0), 0.0)

    def moving(found: np.ndarray) -> np.ndarray:
        still = np.append(False, np.append(~moves, False))
        found[still] = found[:, still] = 0.0
        return found

    return newton(lambda beta: moving(run(curvature, beta)), penalty, iterations)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            some = batch.slice(start, _ROWS)
            flat = some.column(0).flatten()
            if flat.null_count or len(flat) != some.num_rows * width or some.column(1).null_count or some.column(2).null_count:
                raise ValueError(f"Every row needs a vector of {width} numbers, a label and a weight")
            yield flat.to_numpy().reshape(-1, width), some.column(1).to_numpy(), some.column(2).to_numpy()


def _in_one_task(ready: DataFrame, near: np.ndarray, standardize: bool, iterations: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [tuple(a.copy() for a in block) for block in _blocks(batches, len(near))]
        beta = solve(lambda work, value: sum(work(*block, value) for block in blocks), near, standardize, iterations)
        yield pa.RecordBatch.from_arrays([pa.array([beta.tobytes()], pa.binary())], names=["beta"])

    return np.frombuffer(ready.coalesce(1).mapInArrow(run, "beta binary").first()["beta"])


def _in_passes(ready: DataFrame, near: np.ndarray, standardize: bool, iterations: int) -> np.ndarray:
    ready = materialize(ready)

    def total(work: Callable, value: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for block in _blocks(batches, len(near)):
                found = work(*block, value)
                held = found if held is None else held + found
            if held is not None:
                yield _rows_of(range(len(held)), held)

        def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for place, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = np.frombuffer(cells)
                    held[place] = held[place] + found if place in held else found
            if held:
                yield _rows_of(held, held.values())

        parts = ready.coalesce(TASKS).mapInArrow(partial, "place int, cells binary")
        found = parts.repartition("place").mapInArrow(combine, "place int, cells binary").collect()
        return np.array([np.frombuffer(r["cells"]) for r in sorted(found, key=lambda r: r["place"])])

    return solve(total, near, standardize, iterations)


def _rows_of(places, rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(places), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["place", "cells"])


def fit_logistic(
    rows: DataFrame, vector: str, weight: Column, n: int, standardize: bool, iterations: int
) -> LogisticRegressionModel:
    """A model of ``n`` rows with labels 0 and 1."""
    ready = rows.select(vector_to_array(vector).alias("z"), F.col("label").cast("double"), weight.cast("double").alias("weight"))
    near = np.array(ready.first()["z"], np.float64)
    way = _in_one_task if n * len(near) <= LOCAL_CELLS else _in_passes
    beta = way(ready, near, standardize, iterations)
    context = SparkSession.active().sparkContext
    made = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"logreg_{Identifiable()._randomUID()}", _py2java(context, Vectors.dense(beta[:-1].tolist())), float(beta[-1])
    )
    return LogisticRegressionModel(made).setFeaturesCol(vector)
