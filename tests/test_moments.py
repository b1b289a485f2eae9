import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from reviewsift.models import moments, stack
from reviewsift.operators.metrics import ranking_metrics
from reviewsift.plans import views as v


def table(spark, n=400, width=5, folds=4, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * [1, 7, 0.1, 3, 2] + [0, 1e6, -5, 0, 40]
    y = x @ [1.0, -0.5, 20.0, 0.0, 0.3] + rng.normal(size=n)
    fold = rng.integers(0, folds, n)
    data = [(int(f), list(map(float, a)), float(b), int(k % 3 == 0)) for k, (f, a, b) in enumerate(zip(fold, x, y))]
    return x, y, fold, spark.createDataFrame(data, "fold int, x array<double>, y double, label int")


def closed_form(x, y, alpha):
    centred = x - x.mean(0)
    beta = np.linalg.solve(centred.T @ centred + alpha * np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    return beta, y.mean() - x.mean(0) @ beta


def test_every_split_equals_a_fit_of_its_own(spark):
    x, y, fold, df = table(spark)
    parts = moments.fold_moments(df.repartition(7), {"y": F.col("y")}, "fold", ("x", F.col("x"), 5))
    names = [f"x{i}" for i in range(5)]
    assert sorted(parts) == [0, 1, 2, 3] and sum(m.n for m in parts.values()) == 400
    for f, rest in moments.leave_out(parts).items():
        beta, intercept = moments.ridge_solution(rest, names, "y", 10.0)
        want, want_intercept = closed_form(x[fold != f], y[fold != f], 10.0)
        assert np.allclose(beta, want, rtol=1e-9, atol=1e-9)
        assert abs(intercept - want_intercept) < 1e-9 * abs(want_intercept) + 1e-6
        assert np.allclose(rest.mean, np.column_stack([x, y])[fold != f].mean(0), rtol=1e-12)
        assert abs(rest.deviation("x1") / x[fold != f, 1].std() - 1) < 1e-9


def test_standardised_columns_are_penalised_at_their_scale(spark):
    x, y, _, df = table(spark)
    whole = moments.total(moments.fold_moments(df, {"y": F.col("y")}, None, ("x", F.col("x"), 5)))
    scaler = moments.scaler_of(whole, ["x1", "x3"])
    scaled = x.copy()
    for i in (1, 3):
        scaled[:, i] = (x[:, i] - x[:, i].mean()) / x[:, i].std()
    want, want_intercept = closed_form(scaled, y, 10.0)
    beta, intercept = moments.ridge_solution(whole, [f"x{i}" for i in range(5)], "y", 10.0, scaler)
    assert np.allclose(beta, want, rtol=1e-8) and abs(intercept - want_intercept) < 1e-6


def test_made_model_scores_saves_and_loads(spark, tmp_path):
    x, y, _, df = table(spark)
    ready = df.withColumn("f", array_to_vector("x"))
    beta, intercept = closed_form(x, y, 10.0)
    model = moments.linear_model(beta, intercept, "f", "p")
    got = [r["p"] for r in model.transform(ready).select("p").collect()]
    assert np.allclose(got, x @ beta + intercept)
    fitted = stack.ridge(ready, "f", "y")
    # The solver of the library scales its columns, which costs it digits beside an offset of a million.
    assert np.allclose(fitted.coefficients.toArray(), beta, atol=1e-4)
    model.save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    assert np.allclose([r["p"] for r in again.transform(ready).select("p").collect()], got)


def test_edge_cases_of_moments(spark):
    assert moments.fold_moments(spark.createDataFrame([], "fold int, y double"), {"y": F.col("y")}, "fold") == {}
    one = spark.createDataFrame([(0, 2.0), (None, 9.0)], "fold int, y double")
    parts = moments.fold_moments(one, {"y": F.col("y")}, "fold")
    assert parts[0].n == 1 and parts[0].average("y") == 2.0 and moments.leave_out(parts)[0].n == 0
    for bad in (None, float("nan"), float("inf")):
        rows = spark.createDataFrame([(0, bad), (0, 1.0)], "fold int, y double")
        with pytest.raises(Exception, match="numbers"):
            moments.fold_moments(rows, {"y": F.col("y")}, "fold")
    same = spark.createDataFrame([(k % 2, 0.1) for k in range(50)], "fold int, y double")
    assert moments.total(moments.fold_moments(same, {"y": F.col("y")}, "fold")).deviation("y") < 1e-15


def test_class_weights_from_moments(spark):
    _, _, _, df = table(spark)
    whole = moments.total(moments.fold_moments(df, {"label": F.col("label")}))
    assert moments.balanced_weights(whole) == pytest.approx(stack.class_weights(df))


def test_oof_scores_leave_their_fold_out(spark):
    x, y, fold, df = table(spark)
    flat = df.select("fold", "y", *[F.col("x")[i].alias(f"x{i}") for i in range(5)])
    scored, models = moments.oof_ridge(flat, [f"x{i}" for i in range(5)], "y", "fold", 10.0)
    rows = scored.collect()
    for row in rows:
        beta, intercept = models[row["fold"]]
        assert abs(row["oof_prediction"] - (sum(b * row[f"x{i}"] for i, b in enumerate(beta)) + intercept)) < 1e-6
    alone = flat.where("fold = 1")
    assert {r["oof_prediction"] for r in moments.oof_ridge(alone, ["x0"], "y", "fold", 1.0)[0].collect()} == {None}


def test_nested_features_come_from_models_that_never_saw_the_row(spark, small):
    """Labels drawn at random cannot be predicted, only remembered: a forest that saw a row ranks it well."""
    rows = stack.training_rows(v.training(spark, small))
    blind = rows.withColumn("label", (F.xxhash64("annotation_id") % 2 != 0).cast("int"))
    blind = blind.withColumn("helpfulness_score", F.col("label") * 5.0 - 1.0)
    deep = stack.Settings(inner_folds=3, trees=40, rf_depth=20, parallelism=3)
    scored, _, full = stack.nested_oof(blind, None, ["word_count", "rating"], deep, 5)
    score = stack.RF_FEATURES[1]
    seen = ranking_metrics(stack.rf_features(blind, full.rf).select("label", score), "label", score).first()["roc_auc"]
    unseen = ranking_metrics(scored.select("label", score), "label", score).first()["roc_auc"]
    assert seen > 0.95 and unseen < 0.75
    aux = stack.AUX_FEATURES[0]
    seen = stack.aux_features(blind, full.aux, full.scaler).stat.corr("helpfulness_score", aux)
    unseen = scored.stat.corr("helpfulness_score", aux)
    assert seen > 0.2 and abs(unseen) < seen


def test_embedding_width_is_checked(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "x array<double>")
    with pytest.raises(Exception, match="2 numbers"):
        moments.fold_moments(df, {}, None, ("x", F.col("x"), 2))
