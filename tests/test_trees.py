import threading

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from reviewsift.models import forest, logit, stack, trees

DEEP = stack.Settings(trees=12, rf_depth=30, rounds=30, step=0.1, boost_depth=3, logistic_iterations=200, parallelism=4)


def numbers(n=600, width=6, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=n) > 0).astype(int)
    return x, y


def table(spark, x, y):
    data = [(k, list(map(float, a)), int(b), 0.5 + k % 3) for k, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "k int, a array<double>, label int, sample_weight double")
    return df.withColumn("embedding", array_to_vector("a"))


def jobs_of(spark, name, run):
    """How many jobs a call takes."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        run()
        return len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def auc(y, score):
    higher = (score[y == 1][:, None] > score[y == 0]).mean() + 0.5 * (score[y == 1][:, None] == score[y == 0]).mean()
    return float(higher)


def test_cuts_part_distinct_values_and_quantiles():
    assert trees.cuts_of(np.array([3.0, 1.0, 1.0, 2.0]), np.ones(4)).tolist() == [1.5, 2.5]
    assert trees.cuts_of(np.array([7.0, 7.0]), np.ones(2)).tolist() == []
    x = np.random.default_rng(0).exponential(size=50_000)
    cuts = trees.cuts_of(x, np.ones(len(x)))
    shares = np.bincount(trees.binned(x[:, None], [cuts])[:, 0]) / len(x)
    assert len(cuts) == 31 and np.allclose(shares, 1 / 32, atol=1e-3)
    edge = np.array([[cuts[4]]])
    assert trees.binned(edge, [cuts])[0, 0] == 4  # a value on a cut goes left of it


def test_cells_are_packed_without_loss():
    for width in (1, 2, 3, 18, 384):
        cells = np.random.default_rng(width).integers(0, trees.BINS, (7, width)).astype(np.uint8)
        words = trees.packed_cells(cells)
        assert words.nbytes <= 7 * 2 * (width / 3 + 1) and np.array_equal(trees.unpacked_cells(words, width), cells)


def best_split(cells, y, draws, weights, least):
    """Brute force over all features and cuts."""
    found = -1.0
    for f in range(cells.shape[1]):
        for cut in range(trees.BINS - 1):
            left = cells[:, f] <= cut
            if draws[left].sum() < least or draws[~left].sum() < least:
                continue
            score = 0.0
            for side in (left, ~left):
                a, b = (draws[side & (y == c)].sum() * weights[c] for c in (0, 1))
                score += (a * a + b * b) / (a + b)
            found = max(found, score)
    return found


def test_both_ways_find_the_best_split():
    rng = np.random.default_rng(5)
    weights = (0.7, 1.9)
    for n in (4, 9, 30, 64, 300):
        cells = rng.integers(0, 32, (n, 3)).astype(np.uint8)
        y, draws = rng.integers(0, 2, n).astype(np.uint8), rng.integers(1, 4, n).astype(np.uint16)
        args = (cells, np.arange(n), draws, y, np.zeros(1, int), np.array([n]), np.arange(3)[None], weights, 2)
        want = best_split(cells, y, draws.astype(float), weights, 2)
        ways = [trees._by_counts(*args)] + ([trees._by_sorting(*args, trees.SORTED)] if n <= trees.SORTED else [])
        for score, feature, cut in ways:
            assert score[0] == pytest.approx(want, rel=1e-5)
            if want >= 0:
                left = cells[:, feature[0]] <= cut[0]
                assert draws[left].sum() >= 2 and draws[~left].sum() >= 2


def test_a_tree_ends_in_pure_or_small_leaves():
    x, y = numbers(3000)
    cuts = [trees.cuts_of(x[:, k], np.ones(len(x))) for k in range(6)]
    cells = trees.binned(x, cuts)
    draws = trees.draws_of(np.arange(len(y)), 3, 0)
    assert abs(draws.mean() - 1) < 0.1 and abs((draws == 0).mean() - np.exp(-1)) < 0.05
    tree = trees.grow_classifier(cells, y.astype(np.uint8), draws, (1.0, 1.0), 30, 3, np.random.default_rng(1))
    inner = tree.left >= 0
    assert sorted([*tree.left[inner], *(tree.left[inner] + 1)]) == list(range(1, len(tree.left)))
    value = trees.walk(tree, cells)
    assert ((value > 0.5) == (y == 1))[draws > 0].mean() > 0.95
    order = np.random.default_rng(9).permutation(len(y))
    again = trees.grow_classifier(cells[order], y[order].astype(np.uint8), draws[order], (1.0, 1.0), 30, 3, np.random.default_rng(1))
    assert tree.packed() == again.packed()


def test_a_regression_tree_lowers_the_variance_most():
    rng = np.random.default_rng(2)
    cells = rng.integers(0, 32, (80, 4)).astype(np.uint8)
    y, w = rng.normal(size=80), rng.random(80) + 0.1
    tree = trees.grow_regressor(cells, y, w, np.ones(80, bool), 1, 4, rng)

    def rest(left):
        return sum((w[s] * (y[s] - np.average(y[s], weights=w[s])) ** 2).sum() for s in (left, ~left))

    ways = [cells[:, f] <= c for f in range(4) for c in range(31)]
    least = min(rest(left) for left in ways if 0 < left.sum() < 80)
    left = cells[:, tree.feature[0]] <= tree.cut[0]
    assert rest(left) == pytest.approx(least) and len(tree.left) == 3
    assert tree.value[1] == pytest.approx(np.average(y[left], weights=w[left]), rel=1e-6)


def test_forest_is_arrays_and_the_same_for_any_number_of_groups(spark, monkeypatch, tmp_path):
    x, y = numbers()
    df = table(spark, x, y).coalesce(1)
    models = []
    for groups in (2, 5):
        monkeypatch.setattr(forest, "GROUPS", groups)
        models.append(stack.rf_model(df, DEEP, 7))
    one, two = models
    assert one.packed == two.packed and len(one.packed) == DEEP.trees
    # A node is 13 bytes, not an object of the driver.
    assert all(13 * len(p[1]) == sum(map(len, p)) for p in one.packed)
    one.save(spark, str(tmp_path / "rf"))
    again = forest.Forest.load(spark, str(tmp_path / "rf"))
    assert again.packed == one.packed and all(np.array_equal(a, b) for a, b in zip(one.cuts, again.cuts))
    for model in (one, again):
        got = stack.rf_features(df, model).select(*stack.RF_FEATURES).collect()
        score = np.array([r[1] for r in got])
        assert auc(y, score) > 0.97 and all(abs(r[0] + r[1] - 1) < 1e-12 for r in got)
        assert {len(np.unique(score)) > 20, 0 <= score.min(), score.max() <= 1} == {True}


def test_many_cells_are_mapped_from_a_file(spark, monkeypatch):
    x, y = numbers()
    df = table(spark, x, y).coalesce(1)
    want = stack.rf_model(df, DEEP, 7).packed
    monkeypatch.setattr(forest, "IN_MEMORY", 500)
    assert stack.rf_model(df, DEEP, 7).packed == want


def test_bad_rows_of_a_forest_fail(spark):
    x, y = numbers(30)
    df = table(spark, x, y)
    for bad in (df.withColumn("label", F.when(F.col("k") > 3, F.col("label"))), df.withColumn("label", F.lit(2))):
        with pytest.raises(Exception, match="label"):
            stack.rf_model(bad, DEEP, 1, {0: 1.0, 1: 1.0})
    uneven = df.withColumn("embedding", array_to_vector(F.when(F.col("k") > 3, F.col("a")).otherwise(F.slice("a", 1, 2))))
    with pytest.raises(Exception, match="one width"):
        stack.rf_model(uneven, DEEP, 1)
    with pytest.raises(ValueError, match="needs rows"):
        stack.rf_model(df.limit(0), DEEP, 1, {0: 1.0, 1: 1.0})


def test_narrow_tables_are_boosted_in_few_jobs(spark, tmp_path):
    x, y = numbers()
    df = table(spark, x, y)
    made = []
    # Spark ML takes a job for each level of each tree: more than a hundred here.
    assert jobs_of(spark, "boost", lambda: made.append(stack.boosted(df, "embedding", DEEP, 1))) <= 20
    model = made[0]
    assert len(model.packed) == DEEP.rounds
    model.save(spark, str(tmp_path / "final"))
    for m in (model, forest.Boosted.load(spark, str(tmp_path / "final"))):
        got = stack.with_probability(m, df, "embedding").orderBy("k").collect()
        ours = np.array([r["proba_helpful"] for r in got])
        assert auc(y, ours) > 0.95 and 0 <= ours.min() and ours.max() <= 1


def test_boosting_agrees_with_the_library(spark, monkeypatch):
    x, y = numbers(1500)
    df = table(spark, x, y)
    ours = stack.boosted(df, "embedding", DEEP, 1)
    monkeypatch.setattr(stack, "LOCAL_CELLS", 0)
    theirs = stack.boosted(df, "embedding", DEEP, 1)
    a, b = (np.array([r[0] for r in stack.with_probability(m, df, "embedding").orderBy("k").select("proba_helpful").collect()]) for m in (ours, theirs))
    # The samples differ, so scores do as much as those of two seeds.
    assert np.corrcoef(a, b)[0, 1] > 0.93 and np.abs(a - b).mean() < 0.09 and abs(auc(y, a) - auc(y, b)) < 0.02


@pytest.mark.parametrize("standardize,base", [(True, None), (False, "sample_weight")])
def test_logistic_regression_agrees_with_the_library(spark, monkeypatch, standardize, base):
    x, y = numbers(400, 5)
    x = np.hstack([x * [1, 10, 0.1, 1, 3], np.full((400, 1), 2.5)])
    df = table(spark, x, y).withColumn("label", F.when(F.col("k") % 9 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    weighted = stack.with_class_weight(df, stack.class_weights(df), base)
    total = weighted.agg(F.sum("_weight")).first()[0]
    want = LogisticRegression(featuresCol="embedding", labelCol="label", weightCol="_weight", regParam=1.0 / total, standardization=standardize, maxIter=500, tol=1e-9).fit(weighted)
    made = []
    assert jobs_of(spark, f"logistic{standardize}", lambda: made.append(stack.logistic(df, "embedding", DEEP, base, standardize))) <= 8
    monkeypatch.setattr(logit, "LOCAL_CELLS", 0)
    made.append(stack.logistic(df, "embedding", DEEP, base, standardize))
    for model in made:
        assert np.allclose(model.coefficients.toArray(), want.coefficients.toArray(), atol=1e-5)
        assert model.intercept == pytest.approx(want.intercept, abs=1e-5) and model.coefficients[5] == 0
        scored = stack.with_probability(model, df, "embedding").collect()
        assert auc(y, np.array([r["proba_helpful"] for r in scored])) > 0.7


def test_threads_do_not_share_local_properties(spark):
    """Threads that wrote to one set of properties broke each other's queries now and then."""
    sc = spark.sparkContext
    met = threading.Barrier(4, timeout=60)

    def task(k):
        def run():
            sc.setLocalProperty("reviewsift.test", str(k))
            met.wait()
            return sc.getLocalProperty("reviewsift.test")

        return run

    assert stack._parallel([task(k) for k in range(4)], 4) == ["0", "1", "2", "3"]
