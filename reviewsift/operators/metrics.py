"""Classification metrics from counted score levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reviewsift.functions.columns import round_even, safe_div
from reviewsift.operators.ordering import with_running_sums
from reviewsift.operators.reports import describe
from reviewsift.schemas import LABEL_NAMES

METRIC_NAMES = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")


def confusion(
    df: DataFrame, label: str, pred: str, by: Sequence[str] = ()
) -> DataFrame:
    """True and false negatives and positives per group."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def _ranked(levels: DataFrame, by: Sequence[str], also: Sequence[Column] = ()) -> DataFrame:
    """AUC and average precision of score levels with `_pos` and `_neg` counts, per group.

    Levels are range-partitioned by score once, their places frozen in one written table; totals per
    partition combine in score order, so no task sees more than its range.
    """
    summed = with_running_sums(
        levels, [F.col("_score").desc()], {"_tp": F.col("_pos"), "_fp": F.col("_neg")}, by
    )
    precision = F.col("_tp") / (F.col("_tp") + F.col("_fp"))
    # Each negative is beaten by the positives above it and ties with those at its level.
    beaten = F.col("_neg") * (F.col("_tp") - F.col("_pos") + F.col("_pos") / 2)
    totals = summed.groupBy(*by).agg(
        F.sum("_pos").alias("_p"),
        F.sum("_neg").alias("_n"),
        F.sum(beaten).alias("_beaten"),
        # A level without rows of either class has no precision.
        F.sum(F.when(F.col("_pos") > 0, F.col("_pos") * precision).otherwise(0.0)).alias("_ap"),
        *also,
    )
    return totals.withColumns(
        {
            "roc_auc": safe_div(F.col("_beaten"), F.col("_p") * F.col("_n")),
            "pr_auc": safe_div(F.col("_ap"), F.col("_p"), 0.0),
        }
    ).drop("_p", "_n", "_beaten", "_ap")


def ranking_metrics(
    df: DataFrame, label: str, score: str, by: Sequence[str] = ()
) -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision per group.

    Rows are counted per distinct score first, scores as they are. AUC is NULL and average precision
    0 without positives; AUC is NULL without negatives.
    """
    levels = df.groupBy(*by, F.col(score).cast("double").alias("_score")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("_neg"),
    )
    return _ranked(levels, by).select(*by, "roc_auc", "pr_auc")


def binary_metrics(
    df: DataFrame,
    label: str = "label",
    pred: str = "pred",
    score: str = "proba_helpful",
    by: Sequence[str] = (),
    rounded: int | None = None,
) -> DataFrame:
    """Accuracy, precision, recall, F1, ROC-AUC, average precision and the confusion
    counts, per group; ratios without a denominator are 0."""
    y, p = F.col(label), F.col(pred)
    levels = df.groupBy(*by, F.col(score).cast("double").alias("_score")).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(y == 0, 1).otherwise(0)).alias("_neg"),
        *[
            F.count_if((y == a) & (p == b)).alias(c)
            for c, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
        ],
    )
    # Counts of the four cells come with the levels: the data is read once.
    cells = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tn", "fp", "fn", "tp")]
    ranks = _ranked(levels, by, cells)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    result = ranks.withColumns(
        {
            "accuracy": safe_div(tp + tn, tn + fp + fn + tp),
            "precision": safe_div(tp, tp + fp, 0.0),
            "recall": safe_div(tp, tp + fn, 0.0),
            "f1": safe_div(2 * tp, 2 * tp + fp + fn, 0.0),
        }
    )
    shown = [
        F.col(n) if rounded is None else round_even(F.col(n), rounded).alias(n)
        for n in METRIC_NAMES
    ]
    return result.select(*by, *shown, "tn", "fp", "fn", "tp")


def cv_summary(metrics: DataFrame, rounded: int = 6) -> DataFrame:
    """Mean and sample deviation by model, best mean F1 first."""
    aggs = []
    for name in METRIC_NAMES:
        aggs.append(round_even(F.avg(name), rounded).alias(f"{name}_mean"))
        if name not in ("roc_auc", "pr_auc"):
            aggs.append(round_even(F.stddev_samp(name), rounded).alias(f"{name}_std"))
    return metrics.groupBy("model").agg(*aggs).orderBy(F.desc("f1_mean"), "model")


def ablation_delta(
    metrics: DataFrame, base: str, extended: str, metric: str = "f1", rounded: int = 6
) -> DataFrame:
    """Difference of the mean metric between two models."""
    means = metrics.agg(
        *[
            F.avg(F.when(F.col("model") == m, F.col(metric))).alias(n)
            for n, m in (("base_mean", base), ("extended_mean", extended))
        ]
    )
    delta = F.col("extended_mean") - F.col("base_mean")
    return means.select(
        *[round_even(c, rounded).alias(n) for n, c in (
            ("base_mean", F.col("base_mean")),
            ("extended_mean", F.col("extended_mean")),
            ("delta", delta),
        )]
    )


def class_report(df: DataFrame, label: str = "label", pred: str = "pred", rounded: int = 4) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    counts = confusion(df, label, pred)
    classes = []
    for value in LABEL_NAMES:
        right, wrong, missed = ("tp", "fp", "fn") if value == 1 else ("tn", "fn", "fp")
        hit, extra, lost = F.col(right), F.col(wrong), F.col(missed)
        classes.append(
            F.struct(
                F.lit(value).alias("class"),
                round_even(safe_div(hit, hit + extra, 0.0), rounded).alias("precision"),
                round_even(safe_div(hit, hit + lost, 0.0), rounded).alias("recall"),
                round_even(safe_div(2 * hit, 2 * hit + extra + lost, 0.0), rounded).alias("f1"),
                (hit + lost).alias("support"),
            )
        )
    return counts.select(F.explode(F.array(*classes)).alias("_c")).select("_c.*")


def oof_report(oof: DataFrame) -> dict[str, DataFrame]:
    """Pooled metrics, per-class report, confusion counts and auxiliary predictions."""
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    return {
        "metrics": binary_metrics(oof),
        "classes": class_report(oof),
        "confusion": oof.groupBy("label", "pred").agg(F.count("*").alias("count")),
        "auxiliary": describe(oof, ["pred_helpfulness_score", "pred_confidence"], quartiles),
    }
