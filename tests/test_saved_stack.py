import json

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from reviewsift.models import forest, stack
from reviewsift.plans import views as v

QUICK = stack.Settings(inner_folds=2, trees=4, rf_depth=5, rounds=4, step=0.1, boost_depth=3, parallelism=2)


def test_trained_trees_are_arrays_and_earlier_models_still_load(spark, small, tmp_path, monkeypatch):
    rows = stack.training_rows(v.training(spark, small))
    source = v.training(spark, small)
    path = str(tmp_path / "new")
    fitted = stack.train_final(rows, path, QUICK, ["word_count", "rating"])
    # No tree is an object of the driver, neither fitted nor loaded.
    again = stack.load_stack(spark, path)
    for models in (fitted, again):
        assert isinstance(models.rf, forest.Forest) and isinstance(models.final, forest.Boosted)
        assert models.config["arrays"] == ["rf", "final"]
    assert again.rf.packed == fitted.rf.packed and again.final.packed == fitted.final.packed
    pick = ["annotation_id", "helpfulness_score", "predicted_rubric_score"]
    assert sorted(stack.predict(source, fitted).select(pick).collect()) == sorted(stack.predict(source, path).select(pick).collect())

    # As saved before: Spark ML's models and a configuration that names no arrays.
    old = str(tmp_path / "old")
    forest_of_library = RandomForestClassifier(
        featuresCol="embedding", labelCol="label", numTrees=4, probabilityCol="_rf_proba", rawPredictionCol="_rf_raw", predictionCol="_rf_pred"
    ).fit(rows)
    monkeypatch.setattr(stack, "LOCAL_CELLS", 0)
    trained = stack.stack_features(stack._score_level_one(rows, stack.StackModels(forest_of_library, fitted.scaler, fitted.aux)), fitted.scaler)
    stack.boosted(trained, "stack_features", QUICK, 1).write().save(f"{old}/final")
    forest_of_library.write().save(f"{old}/rf")
    for target, model in fitted.aux.items():
        model.write().save(f"{old}/aux_{target}")
    config = {k: x for k, x in fitted.config.items() if k != "arrays"}
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.text(f"{old}/config")
    scored = stack.predict(source, old).select(F.min("helpfulness_score"), F.max("helpfulness_score"), F.count("*")).first()
    assert 0 <= scored[0] <= scored[1] <= 1 and scored[2] == source.count()
