"""Leakage-safe stacked classifier on Spark ML."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassificationModel,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewsift.functions.columns import WHITE_SPACE, clip, round_even, text_or_empty
from reviewsift.functions.features import (
    metadata_features, reason_codes, sample_weight_of,
)
from reviewsift.lexicon import Lexicon, VIETNAMESE
from reviewsift.models.forest import (
    LOCAL_CELLS, LOCAL_WIDTH, Boosted, Forest, fit_boosted, fit_forest,
)
from reviewsift.models.logit import fit_logistic
from reviewsift.models.moments import (
    Moments, balanced_weights, fold_moments, leave_out, linear_model, ridge_solution, scaler_of,
    total,
)
from reviewsift.operators.explain import decide
from reviewsift.operators.metrics import binary_metrics
from reviewsift.operators.ranking import stratified_folds
from reviewsift.operators.validate import constant_columns
from reviewsift.schemas import LABEL_NAMES, METADATA_FEATURES
from reviewsift.session import materialize

# ---------------------------------------------------------------------------
# Ranges of the auxiliary predictions and model settings.
# ---------------------------------------------------------------------------
SCORE_RANGE = (-2.0, 7.0)
CONFIDENCE_RANGE = (0.0, 1.0)
RIDGE_ALPHA = 10.0
AUX_TARGETS = {"helpfulness_score": SCORE_RANGE, "confidence": CONFIDENCE_RANGE}
AUX_FEATURES = ("predicted_helpfulness_score", "predicted_confidence")
RF_FEATURES = ("rf_proba_not_helpful", "rf_proba_helpful")
CANDIDATES = (
    "metadata_logistic", "embedding_logistic", "embedding_metadata_logistic",
    "stack_nested_oof", "stack_nested_oof_aux",
)


@dataclass(frozen=True)
class Settings:
    """Sizes of the models; the defaults are the full mode."""

    outer_folds: int = 5
    inner_folds: int = 3
    trees: int = 300
    rf_depth: int = 30  # Spark's limit; the forest has no other
    rounds: int = 500
    step: float = 0.03
    boost_depth: int = 5
    logistic_iterations: int = 1500
    seed: int = 42
    parallelism: int = 4


FAST = Settings(outer_folds=3, inner_folds=2, trees=100, rounds=150)


def _parallel(tasks: Sequence[Callable[[], object]], parallelism: int) -> list:
    """Run independent fits from driver threads; the fits themselves are Spark jobs."""
    if parallelism <= 1 or len(tasks) == 1:
        return [task() for task in tasks]
    # Each task gets its own copy of the local properties: threads that share one overwrite each other's.
    session = SparkSession.active()
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return pool.map(lambda task: task(), [inheritable_thread_target(session)(task) for task in tasks])


# --- inputs ----------------------------------------------------------------


def training_rows(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Features, targets and weights of the modelling jobs, written once.

    Needs `annotation_id`, title, content, rating, `is_helpful`, `helpfulness_score`,
    `confidence` and an embedding column (array or vector). Blank texts are left out.
    """
    vector = F.col(embedding)
    if dict(df.dtypes)[embedding].startswith("array"):
        vector = array_to_vector(vector.cast("array<double>"))
    score = F.coalesce(F.col("helpfulness_score").try_cast("double"), F.lit(0.0))
    confidence = clip(
        F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5)), *CONFIDENCE_RANGE
    )
    has_text = F.concat(text_or_empty("title"), text_or_empty("content")).rlike(
        f"[^{WHITE_SPACE}]"
    )
    rows = metadata_features(df.filter(has_text))
    rows = rows.withColumns(
        {
            "label": F.col("is_helpful").cast("int"),
            "helpfulness_score": score,
            "confidence": confidence,
            "embedding": vector,
        }
    ).withColumn("sample_weight", sample_weight_of("confidence", "helpfulness_score"))
    return materialize(
        rows.select(
            "annotation_id", "label", *AUX_TARGETS, "sample_weight", "embedding",
            *METADATA_FEATURES,
        )
    )


def usable_metadata(
    rows: DataFrame, columns: Sequence[str] = METADATA_FEATURES
) -> list[str]:
    """Metadata columns that are not constant; label-derived values are refused."""
    leaking = set(columns) & set(AUX_TARGETS)
    if leaking:
        raise ValueError(f"Label-derived columns cannot be features: {sorted(leaking)}")
    constant = {
        r["column"] for r in constant_columns(rows, columns).filter("is_constant").collect()
    }
    return [c for c in columns if c not in constant]


# --- building blocks ---------------------------------------------------------


def class_weights(rows: DataFrame, label: str = "label") -> dict[int, float]:
    """M9: balanced weights n / (k * n_c); a two-row result."""
    return balanced(class_counts(rows, label))


def class_counts(rows: DataFrame, label: str = "label") -> dict[int, int]:
    return {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}


def balanced(counts: Mapping[int, int]) -> dict[int, float]:
    total = sum(counts.values())
    return {value: total / (len(counts) * n) for value, n in counts.items()}


def _width(rows: DataFrame, vector: str) -> int:
    first = rows.select(F.size(vector_to_array(vector)).alias("width")).first()
    return first["width"] if first else 0


def with_class_weight(
    rows: DataFrame, weights: Mapping[int, float], base: str | None = None, output: str = "_weight"
) -> DataFrame:
    """M9: balanced class weight, times a sample weight column if given."""
    value = F.lit(None).cast("double")
    for label, weight in weights.items():
        value = F.when(F.col("label") == label, weight).otherwise(value)
    return rows.withColumn(output, value if base is None else value * F.col(base))


def fit_scaler(rows: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """M8: mean and population deviation per column (a constant column keeps scale 1)."""
    row = rows.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def scaled(scaler: Mapping[str, tuple[float, float]]) -> list[Column]:
    return [
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - mean) / scale
        for c, (mean, scale) in scaler.items()
    ]


def scale_metadata(
    rows: DataFrame, scaler: Mapping[str, tuple[float, float]], prefix: str = "scaled_"
) -> DataFrame:
    """M8: add the scaled columns."""
    return rows.withColumns({f"{prefix}{c}": v for c, v in zip(scaler, scaled(scaler))})


def assemble(
    rows: DataFrame, parts: Sequence[Column], output: str, width: int | None = None
) -> DataFrame:
    """M4: concatenate numbers and arrays into one vector; a wrong width raises."""
    arrays = [p if _is_array(rows, p) else F.array(p.cast("double")) for p in parts]
    joined = F.concat(*arrays)
    if width is not None:
        joined = F.when(F.size(joined) == width, joined).otherwise(
            F.raise_error(
                F.concat(F.lit(f"Expected {width} features, got "), F.size(joined).cast("string"))
            ).cast("array<double>")
        )
    return rows.withColumn(output, array_to_vector(joined))


def _is_array(rows: DataFrame, part: Column) -> bool:
    return rows.select(part).schema[0].dataType.typeName() == "array"


def embedding_array() -> Column:
    return vector_to_array("embedding")


def rf_model(
    rows: DataFrame, settings: Settings, seed: int, weights: Mapping[int, float] | None = None
) -> Forest:
    """M3: balanced random forest on the embedding; ``weights`` are those of the classes, if known.

    Trees are grown in groups, a group per task, over a table of one byte per cell; each row stays with
    its node between the levels. The driver gets the finished nodes as arrays, 13 bytes a node.
    """
    return fit_forest(rows, "embedding", weights or class_weights(rows), settings.trees, settings.rf_depth, seed)


def rf_features(rows: DataFrame, model: Forest | RandomForestClassificationModel) -> DataFrame:
    """M3: the two forest probabilities as columns."""
    if isinstance(model, Forest):
        rows = rows.withColumn(RF_FEATURES[1], model.score("embedding"))
        return rows.withColumn(RF_FEATURES[0], 1.0 - F.col(RF_FEATURES[1])).select(*rows.columns[:-1], *RF_FEATURES)
    proba = vector_to_array("_rf_proba")
    scored = model.transform(rows)
    return scored.withColumns(
        {RF_FEATURES[0]: proba[0], RF_FEATURES[1]: proba[1]}
    ).drop("_rf_proba", "_rf_raw", "_rf_pred")


def ridge(
    rows: DataFrame, features: str, target: str, alpha: float = RIDGE_ALPHA
) -> LinearRegressionModel:
    """M7: ridge regression with penalty ``alpha`` on the plain squared error.

    Spark scales the target and averages the loss, so the penalty is alpha * std(y) / n. The
    normal equations need one pass over the rows, whatever their number.
    """
    stats = rows.agg(F.count(target).alias("n"), F.stddev_pop(target).alias("std")).first()
    return LinearRegression(
        featuresCol=features, labelCol=target, predictionCol="_ridge", elasticNetParam=0.0,
        regParam=alpha * (stats["std"] or 0.0) / max(stats["n"], 1), standardization=False,
        solver="normal",
    ).fit(rows)


def split_moments(
    rows: DataFrame, metadata: Sequence[str], fold: str | None = None, width: int | None = None
) -> dict[int, Moments]:
    """Moments of embedding, metadata, targets and label per fold: one pass over the rows.

    Scalers, class weights and auxiliary regressors of every split follow from them.
    """
    if width is None:
        first = rows.select(F.size(embedding_array()).alias("width")).first()
        width = first["width"] if first else 0
    numbers = {c: F.col(c) for c in (*metadata, *AUX_TARGETS, "label")}
    return fold_moments(rows, numbers, fold, ("embedding_", embedding_array(), width))


def aux_of(moments: Moments, scaler: Mapping[str, tuple[float, float]]) -> dict[str, LinearRegressionModel]:
    """M7: predictors of the rubric score and of the annotation confidence, from the moments of their rows."""
    features = [c for c in moments.names if c.startswith("embedding_")] + list(scaler)
    return {
        target: linear_model(*ridge_solution(moments, features, target, RIDGE_ALPHA, scaler), "_aux_features", "_ridge")
        for target in AUX_TARGETS
    }


def aux_regressors(
    rows: DataFrame, scaler: Mapping[str, tuple[float, float]]
) -> dict[str, LinearRegressionModel]:
    """M7: both predictors fit on all rows of a table."""
    return aux_of(total(split_moments(rows, list(scaler))), scaler)


def aux_features(
    rows: DataFrame,
    models: Mapping[str, LinearRegressionModel],
    scaler: Mapping[str, tuple[float, float]],
) -> DataFrame:
    """M7: both predictions, clipped to their ranges."""
    rows = assemble(rows, [embedding_array(), *scaled(scaler)], "_aux_features")
    for name, target in zip(AUX_FEATURES, AUX_TARGETS):
        rows = models[target].transform(rows)
        rows = rows.withColumn(name, clip(F.col("_ridge"), *AUX_TARGETS[target])).drop("_ridge")
    return rows.drop("_aux_features")


def boosted(
    rows: DataFrame, features: str, settings: Settings, seed: int
) -> Boosted | GBTClassificationModel:
    """M5: boosted trees with balanced and sample weights.

    A narrow table is boosted by one task that holds a byte per cell; in Spark ML each level of each tree is
    a job. Wide or very long tables have enough work in a job to be spread out.
    """
    counts = class_counts(rows)
    weighted = with_class_weight(rows, balanced(counts), "sample_weight")
    width = _width(rows, features)
    if 0 < width <= LOCAL_WIDTH and width * sum(counts.values()) <= LOCAL_CELLS:
        return fit_boosted(weighted, features, F.col("_weight"), settings.rounds, settings.step, settings.boost_depth, 0.8, 0.8, seed)
    return GBTClassifier(
        featuresCol=features, labelCol="label", weightCol="_weight", maxIter=settings.rounds,
        stepSize=settings.step, subsamplingRate=0.8, featureSubsetStrategy="0.8",
        maxDepth=settings.boost_depth, seed=seed,
    ).fit(weighted)


def logistic(
    rows: DataFrame,
    features: str,
    settings: Settings,
    base_weight: str | None = None,
    standardize: bool = False,
):
    """M6: balanced logistic regression with unit L2 penalty on the summed loss.

    ``standardize`` penalises the coefficients of the standardised features, as a scaler in
    front would; it needs no pass per feature, so it suits wide embeddings.
    """
    counts = class_counts(rows)
    weighted = with_class_weight(rows, balanced(counts), base_weight)
    if set(counts) == {0, 1}:
        return fit_logistic(weighted, features, F.col("_weight"), sum(counts.values()), standardize, settings.logistic_iterations)
    # Other labels have no such loss, or no least one.
    total = weighted.agg(F.sum("_weight")).first()[0]
    return LogisticRegression(
        featuresCol=features, labelCol="label", weightCol="_weight", regParam=1.0 / total,
        standardization=standardize, maxIter=settings.logistic_iterations,
    ).fit(weighted)


def with_probability(model, rows: DataFrame, features: str) -> DataFrame:
    """Add `proba_helpful`, the probability of class 1."""
    if isinstance(model, Boosted):
        return rows.withColumn("proba_helpful", model.score(features))
    scored = model.setFeaturesCol(features).setProbabilityCol("_proba").transform(rows)
    return scored.withColumn("proba_helpful", vector_to_array("_proba")[1]).drop(
        "_proba", "rawPrediction", "prediction"
    )


# --- nested out-of-fold features ---------------------------------------------


@dataclass
class StackModels:
    """Models fit on all training rows, used to score new rows."""

    rf: Forest | RandomForestClassificationModel
    scaler: dict[str, tuple[float, float]]
    aux: dict[str, LinearRegressionModel]
    final: Boosted | GBTClassificationModel | None = None
    config: dict = field(default_factory=dict)


def stack_width(metadata: Sequence[str], aux: bool) -> int:
    return len(RF_FEATURES) + len(metadata) + (len(AUX_FEATURES) if aux else 0)


def stack_features(
    rows: DataFrame, scaler: Mapping[str, tuple[float, float]]
) -> DataFrame:
    """M4: `base_features` and `stack_features` vectors in the fixed order."""
    base = [F.col(c) for c in RF_FEATURES] + scaled(scaler)
    extended = base + [F.col(c) for c in AUX_FEATURES]
    names = list(scaler)
    rows = assemble(rows, base, "base_features", stack_width(names, False))
    return assemble(rows, extended, "stack_features", stack_width(names, True))


def _score_level_one(rows: DataFrame, models: StackModels) -> DataFrame:
    return aux_features(rf_features(rows, models.rf), models.aux, models.scaler)


def _fit_level_one(
    rows: DataFrame, moments: Moments, metadata: Sequence[str], settings: Settings, seed: int
) -> StackModels:
    """Models of one split; ``moments`` are those of its rows."""
    scaler = scaler_of(moments, metadata)
    forest = rf_model(rows, settings, seed, balanced_weights(moments))
    return StackModels(forest, scaler, aux_of(moments, scaler))


def nested_oof(
    train: DataFrame,
    valid: DataFrame | None,
    metadata: Sequence[str],
    settings: Settings,
    seed: int,
) -> tuple[DataFrame, DataFrame | None, StackModels]:
    """Stack features for training rows from models that never saw them, and for
    validation rows from models fit on all training rows.

    Every training row is scored exactly once, by the models of the other inner folds. All linear
    parts come from one pass over the rows: a split's moments are the total's minus the fold's.
    """
    folded = stratified_folds(train, "label", settings.inner_folds, seed, output="inner_fold")
    folded = materialize(folded)
    parts = split_moments(folded, metadata, "inner_fold")
    others = leave_out(parts)

    def inner(i: int) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            fit = folded.filter(F.col("inner_fold") != i)
            models = _fit_level_one(fit, others[i], metadata, settings, seed + i + 1)
            return _score_level_one(folded.filter(F.col("inner_fold") == i), models)

        return run

    tasks: list[Callable[[], object]] = [inner(i) for i in range(settings.inner_folds)]
    tasks.append(lambda: _fit_level_one(folded, total(parts), metadata, settings, seed + 100))
    *scored, full = _parallel(tasks, settings.parallelism)
    oof = reduce(DataFrame.unionByName, scored)
    train_rows = materialize(stack_features(oof, full.scaler))
    if valid is None:
        return train_rows, None, full
    valid_rows = materialize(stack_features(_score_level_one(valid, full), full.scaler))
    return train_rows, valid_rows, full


# --- outer cross-validation -----------------------------------------------------


def _fold_predictions(
    rows: DataFrame, fold: int, metadata: Sequence[str], settings: Settings
) -> DataFrame:
    """Predictions of the five candidates for one outer fold, in long form."""
    train = rows.filter(F.col("fold") != fold)
    valid = rows.filter(F.col("fold") == fold)
    seed = settings.seed + (fold + 1) * 1000
    stack_train, stack_valid, level_one = nested_oof(train, valid, metadata, settings, seed)
    scaler = level_one.scaler
    views = {
        "metadata_logistic": (scaled(scaler), None, False),
        "embedding_logistic": ([embedding_array()], None, True),
        "embedding_metadata_logistic": (
            [embedding_array(), *scaled(scaler)], "sample_weight", False,
        ),
    }

    def baseline(name: str) -> Callable[[], DataFrame]:
        parts, weight, standardize = views[name]

        def run() -> DataFrame:
            fit, score = (assemble(part, parts, "_x") for part in (train, valid))
            return with_probability(logistic(fit, "_x", settings, weight, standardize), score, "_x")

        return run

    def stacked(features: str) -> Callable[[], DataFrame]:
        return lambda: with_probability(boosted(stack_train, features, settings, seed), stack_valid, features)

    tasks = [baseline(n) for n in CANDIDATES[:3]] + [
        stacked("base_features"), stacked("stack_features"),
    ]
    scored = _parallel(tasks, settings.parallelism)
    parts = []
    for name, part in zip(CANDIDATES, scored):
        aux = [
            F.col(c).alias(out) if c in part.columns else F.lit(None).cast("double").alias(out)
            for c, out in zip(AUX_FEATURES, ("pred_helpfulness_score", "pred_confidence"))
        ]
        parts.append(
            part.select(
                F.lit(fold + 1).alias("fold"),
                F.lit(name).alias("model"),
                "annotation_id",
                "label",
                "proba_helpful",
                (F.col("proba_helpful") >= 0.5).cast("int").alias("pred"),
                *aux,
            )
        )
    return materialize(reduce(DataFrame.unionByName, parts))


OOF_COLUMNS = ("review_id", "sample_group", "title", "content")


def outer_cv(
    rows: DataFrame,
    settings: Settings = Settings(),
    metadata: Sequence[str] | None = None,
    reviews: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(metrics per fold and model, out-of-fold rows of the extended stack).

    ``rows`` comes from :func:`training_rows`. ``reviews`` adds its ``OOF_COLUMNS`` to the
    out-of-fold rows; texts are joined there and never travel through the fits.
    """
    names = list(metadata) if metadata is not None else usable_metadata(rows)
    folded = materialize(stratified_folds(rows, "label", settings.outer_folds, settings.seed))
    # The fits of a fold run side by side. Folds that do so too cost the driver memory and save little time.
    folds = [_fold_predictions(folded, f, names, settings) for f in range(settings.outer_folds)]
    predictions = reduce(DataFrame.unionByName, folds)
    metrics = binary_metrics(predictions, by=["fold", "model"])
    oof = predictions.filter(F.col("model") == CANDIDATES[-1]).drop("model")
    if reviews is not None:
        shown = reviews.select("annotation_id", *[c for c in OOF_COLUMNS if c in reviews.columns])
        oof = oof.join(shown, "annotation_id", "left")
    return metrics, oof


# --- final model -------------------------------------------------------------------


def train_final(
    rows: DataFrame,
    path: str,
    settings: Settings = Settings(),
    metadata: Sequence[str] | None = None,
    variant: str = "stacked_trees",
    model_id: str = "local",
) -> StackModels:
    """Train the deployable stack on all rows and save models and configuration."""
    names = list(metadata) if metadata is not None else usable_metadata(rows)
    train, _, models = nested_oof(rows, None, names, settings, settings.seed + 9000)
    models.final = boosted(train, "stack_features", settings, settings.seed)
    models.config = {
        "model_variant": variant,
        "model_id": model_id,
        "target": "is_helpful",
        "label_mapping": {str(k): v for k, v in LABEL_NAMES.items()},
        "stacking": "nested_oof",
        "metadata_cols": names,
        "scaler": {c: list(v) for c, v in models.scaler.items()},
        "final_features": [*RF_FEATURES, *names, *AUX_FEATURES],
        "raw_values_used_as_inputs": False,
        "training_supervision": list(AUX_TARGETS),
        "confidence_used_as_sample_weight": True,
        "settings": asdict(settings),
        "arrays": [name for name, model in (("rf", models.rf), ("final", models.final)) if isinstance(model, (Forest, Boosted))],
    }
    for name in ("rf", "final"):
        model = getattr(models, name)
        if name in models.config["arrays"]:
            model.save(rows.sparkSession, f"{path}/{name}")
        else:
            model.write().overwrite().save(f"{path}/{name}")
    for target, model in models.aux.items():
        model.write().overwrite().save(f"{path}/aux_{target}")
    spark = rows.sparkSession
    text = json.dumps(models.config, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/config"
    )
    return models


def load_stack(spark: SparkSession, path: str) -> StackModels:
    """Read a saved stack; earlier ones hold Spark ML's trees."""
    config = json.loads(spark.read.text(f"{path}/config", wholetext=True).first()["value"])
    arrays = config.get("arrays", [])
    return StackModels(
        Forest.load(spark, f"{path}/rf") if "rf" in arrays else RandomForestClassificationModel.load(f"{path}/rf"),
        {c: tuple(v) for c, v in config["scaler"].items()},
        {t: LinearRegressionModel.load(f"{path}/aux_{t}") for t in AUX_TARGETS},
        Boosted.load(spark, f"{path}/final") if "final" in arrays else GBTClassificationModel.load(f"{path}/final"),
        config,
    )


def predict(
    df: DataFrame,
    models: StackModels | str,
    threshold: float = 0.5,
    lexicon: Lexicon = VIETNAMESE,
    review_text: str = "content",
) -> DataFrame:
    """Score reviews in one distributed pass.

    Needs title, content, rating and an `embedding`; adds label, score, confidence level,
    reason codes, both auxiliary predictions and the model's names.
    """
    if isinstance(models, str):
        models = load_stack(df.sparkSession, models)
    if dict(df.dtypes)["embedding"].startswith("array"):
        df = df.withColumn("embedding", array_to_vector(F.col("embedding").cast("array<double>")))
    given = df.columns
    df = reason_codes(df, review_text, lexicon)
    rows = df.withColumn("_rating", F.col("rating"))
    if "word_count" in given:
        rows = rows.withColumn("_word_count", F.col("word_count"))
    rows = metadata_features(rows)
    rows = stack_features(_score_level_one(rows, models), models.scaler)
    rows = with_probability(models.final, rows, "stack_features")
    rows = decide(rows, "proba_helpful", threshold)
    rows = rows.withColumns(
        {
            "rating": F.col("_rating"),
            "predicted_rubric_score": round_even(F.col(AUX_FEATURES[0]), 3),
            "predicted_annotation_confidence": round_even(F.col(AUX_FEATURES[1]), 3),
            "model_variant": F.lit(models.config["model_variant"]),
            "model_id": F.lit(models.config["model_id"]),
        }
    )
    if "word_count" in given:
        rows = rows.withColumn("word_count", F.col("_word_count"))
    added = [
        "label", "helpfulness_score", "confidence_level", "model_reason_codes",
        "predicted_rubric_score", "predicted_annotation_confidence", "model_variant", "model_id",
    ]
    return rows.select(*[c for c in given if c not in (*added, "embedding")], *added)
