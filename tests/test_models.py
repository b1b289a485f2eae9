import tracemalloc

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from reviewsift.models import embed, stack
from reviewsift.plans import views as v

QUICK = stack.Settings(
    outer_folds=2, inner_folds=2, trees=5, rf_depth=4, rounds=3, step=0.1, boost_depth=3,
    logistic_iterations=30, parallelism=2,
)


@pytest.fixture(scope="module")
def rows(spark, small):
    return stack.training_rows(v.training(spark, small))


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)) * [1, 5, 0.2, 2]
    y = x @ [1.0, -0.5, 2.0, 0.0] + 3 + rng.normal(size=60)
    centred, target = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(centred.T @ centred + 10 * np.eye(4), centred.T @ target)
    data = [(list(map(float, a)), float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(data, "x array<double>, y double")
    df = df.withColumn("f", array_to_vector("x"))
    model = stack.ridge(df, "f", "y")
    assert np.allclose(model.coefficients.toArray(), beta, atol=1e-6)
    assert abs(model.intercept - (y.mean() - x.mean(0) @ beta)) < 1e-6


def test_hash_counts_match_word_bounded_windows():
    def windows(text):
        grams = []
        for n in (3, 4, 5):
            for word in text.lower().split():
                padded = f" {word} "
                grams += [padded[i : i + n] for i in range(len(padded) - n + 1)]
        return grams

    for text in ("Ab  cde\tf", "độ bền tốt 😀", "a", ""):
        assert embed.hash_vector(text, 384, normalize=False).sum() == len(windows(text))
    one, two = (embed.hash_vector(t, 384, normalize=False) for t in ("pin tốt", "tốt pin PIN"))
    assert np.array_equal(two - one, embed.hash_vector("pin", 384, normalize=False))


def test_hash_embedding_has_unit_length_and_no_negative_values(spark):
    df = spark.createDataFrame([("pin tốt",), ("",)], "t string")
    out = [np.array(r[0]) for r in embed.hash_embed(df, "t").select(vector_to_array("embedding")).collect()]
    assert len(out[0]) == 384
    assert abs((out[0] ** 2).sum() - 1) < 1e-6 and (out[0] >= 0).all()
    assert not out[1].any()


def test_mean_pool_ignores_masked_tokens():
    hidden = np.array([[[1.0, 3.0], [3.0, 5.0], [100.0, 100.0]]])
    assert embed.mean_pool(hidden, np.array([[1, 1, 0]])).tolist() == [[2.0, 4.0]]
    assert embed.mean_pool(hidden, np.array([[0, 0, 0]])).tolist() == [[0.0, 0.0]]


def test_encoder_cache_only_encodes_new_rows(spark, tmp_path):
    def make():
        return lambda texts: np.array([[len(t)] for t in texts], dtype=np.float32)

    path = str(tmp_path / "cache")
    first = spark.createDataFrame([("a", "xx"), ("b", "yyy")], "id string, t string")
    embed.encode_cached(first, "id", "t", make, path).collect()
    second = spark.createDataFrame([("a", "xx"), ("c", "zzzz")], "id string, t string")
    got = {r["id"]: r["embedding"][0] for r in embed.encode_cached(second, "id", "t", make, path).collect()}
    assert got == {"a": 2.0, "c": 4.0}
    assert spark.read.parquet(path).count() == 3


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "label int")
    assert stack.class_weights(df) == {0: 4 / 6, 1: 4 / 2}


def test_scaler_uses_population_deviation_and_keeps_constants(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "a double, b double")
    scaler = stack.fit_scaler(df, ["a", "b"])
    assert scaler == {"a": (2.0, 1.0), "b": (7.0, 1.0)}
    out = stack.scale_metadata(df, scaler).collect()
    assert [r["scaled_a"] for r in out] == [-1.0, 1.0]
    assert [r["scaled_b"] for r in out] == [0.0, 0.0]


def test_assemble_rejects_a_wrong_width(spark):
    df = spark.createDataFrame([([1.0, 2.0], 3.0)], "e array<double>, x double")
    good = stack.assemble(df, [F.col("e"), F.col("x")], "f", 3).select(vector_to_array("f")).first()[0]
    assert good == [1.0, 2.0, 3.0]
    with pytest.raises(Exception, match="Expected 4 features"):
        stack.assemble(df, [F.col("e"), F.col("x")], "f", 4).collect()


def test_label_derived_features_are_refused(rows):
    with pytest.raises(ValueError, match="Label-derived"):
        stack.usable_metadata(rows, ["rating", "confidence"])


def test_nested_oof_covers_each_row_once(rows):
    names = ["word_count", "rating"]
    train, _, models = stack.nested_oof(rows, None, names, QUICK, 1)
    got = train.agg(
        F.count("*").alias("n"),
        F.count_distinct("annotation_id").alias("ids"),
        F.max(F.abs(F.col(stack.RF_FEATURES[0]) + F.col(stack.RF_FEATURES[1]) - 1)).alias("gap"),
        F.min("predicted_confidence").alias("low"),
        F.max("predicted_confidence").alias("high"),
        F.min(F.size(vector_to_array("stack_features"))).alias("width"),
    ).first()
    assert got["n"] == got["ids"] == rows.count()
    assert got["gap"] < 1e-9 and got["low"] >= 0 and got["high"] <= 1
    assert got["width"] == stack.stack_width(names, True) == 6
    assert list(models.scaler) == names


def test_train_save_load_predict(spark, small, rows, tmp_path):
    path = str(tmp_path / "model")
    stack.train_final(rows, path, QUICK, ["word_count", "rating", "text_len"])
    source = v.training(spark, small)
    scored = stack.predict(source, path)
    out = scored.select(
        "label", "helpfulness_score", "confidence_level", "predicted_rubric_score", "model_variant"
    ).collect()
    assert len(out) == source.count()
    assert all((r["label"] == "Helpful") == (r["helpfulness_score"] >= 0.5) for r in out if r["helpfulness_score"] != 0.5)
    assert {r["confidence_level"] for r in out} <= {"High", "Medium", "Low"}
    assert all(-2 <= r["predicted_rubric_score"] <= 7 for r in out)


def test_embedding_makes_no_object_per_row(spark):
    matrix = np.arange(20_000 * 30, dtype=np.float32).reshape(20_000, 30)
    tracemalloc.start()
    lists = embed.list_array(matrix)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.3 * matrix.nbytes and lists[7].as_py() == matrix[7].tolist()


def test_encoder_takes_batches_as_they_are_needed(spark):
    def make():
        def encoder(texts):
            # A batch of Arrow rows that became strings as a whole is kept by the array that was cut.
            assert len(texts) <= 8 and texts.base is None
            return np.array([[len(t)] for t in texts], dtype=np.float32)

        return encoder

    df = spark.createDataFrame([(i, "x" * i) for i in range(100)], "id int, t string").coalesce(1)
    out = embed.encode(df, "t", make, batch_size=8).select("id", "embedding").collect()
    assert all(r["embedding"] == [float(r["id"])] for r in out) and len(out) == 100
    with pytest.raises(Exception, match="An encoder of 8 texts"):
        embed.encode(df, "t", lambda: lambda texts: np.zeros((1, 1), np.float32), batch_size=8).collect()


def test_forest_keeps_the_nodes_of_the_rows(spark):
    data = [([float(i % 7), float(i % 5)], i % 2) for i in range(60)]
    df = spark.createDataFrame(data, "e array<double>, label int")
    df = df.select(array_to_vector("e").alias("embedding"), "label")
    model = stack.rf_model(df, QUICK, 1)
    assert model.getCacheNodeIds() and model.getNumTrees == QUICK.trees
