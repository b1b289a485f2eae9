import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewsift.operators import gold, metrics, ordering, ranking, reports, sketches, stats, validate
from reviewsift.schemas import ANNOTATION_BATCH, CHECKPOINT, LABELS
from reviewsift.sources import io
from reviewsift.sources.manifest import manifest


# --- sources ---------------------------------------------------------------------------------


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        'rating,review_id,title,content,product_id,user_id,created_at,helpful_count,purchased,crawled_at\n'
        '5,007,"a ""b""","line 1\nline 2, x",p,u,2024-01-02,3,True,\n'
        "bad,8,,,p,u,,x,,\n", encoding="utf-8")
    first, second = io.read_reviews(spark, str(tmp_path / "r.csv")).orderBy("review_id").collect()
    assert (first["review_id"], first["rating"], first["title"]) == ("007", 5, 'a "b"')
    assert first["content"] == "line 1\nline 2, x" and first["purchased"] is True
    assert second["rating"] is None and second["helpful_count"] is None


def test_batches_carry_their_file_name(spark, tmp_path):
    header = ",".join(f.name for f in ANNOTATION_BATCH)
    for name in ("b1.csv", "b2.csv"):
        row = ",".join(["1" if f.name == "rating" else "x" for f in ANNOTATION_BATCH])
        (tmp_path / name).write_text(f"{header}\n{row}\n")
    (tmp_path / "notes.txt").write_text("skip")
    rows = io.read_batches(spark, str(tmp_path), ANNOTATION_BATCH).collect()
    assert sorted(r["source_file"] for r in rows) == ["b1.csv", "b2.csv"]
    assert rows[0]["rating"] == 1 and rows[0]["word_count"] is None


def test_missing_columns_are_listed(spark):
    with pytest.raises(ValueError, match="b.*c"):
        io.require_columns(spark.range(1).toDF("a"), ["a", "c", "b"])


def test_defaults(spark):
    df = spark.createDataFrame([("a", "x y", "2"), ("a", "x y", "?")], "title string, content string, rating string")
    rows = io.with_defaults(df).collect()
    assert [r["rating"] for r in rows] == [2, 0]
    assert rows[0]["word_count"] == 3 and rows[0]["review_text"] == "a. x y"
    assert rows[0]["annotation_id"] == rows[1]["annotation_id"]


def label(spark, rows, extra=""):
    names = [f.name for f in LABELS]
    data = []
    for r in rows:
        base = dict.fromkeys(names)
        base.update({"quality_flags": [], "is_helpful": 1, "confidence": 0.9, "label_source": "llm"})
        base.update(r)
        data.append(tuple(base[n] for n in names))
    return spark.createDataFrame(data, LABELS)


def test_checkpoint_last_batch_wins(spark, tmp_path):
    path = str(tmp_path / "c")
    io.append_checkpoint(label(spark, [{"annotation_id": "a"}, {"annotation_id": "b"}]), path, 0)
    io.append_checkpoint(label(spark, [{"annotation_id": "a", "confidence": 0.1}]), path, 1)
    got = {r["annotation_id"]: r["confidence"] for r in io.read_checkpoint(spark, path).collect()}
    assert got == {"a": 0.1, "b": 0.9}


def test_latest_labels_of_an_id_with_very_many_copies(spark):
    names = [f.name for f in CHECKPOINT]
    hot = spark.range(3000).select(
        *[
            F.lit("hot").alias(n) if n == "annotation_id"
            else F.col("id").alias(n) if n == "batch_seq"
            else F.lit(None).cast(f.dataType).alias(n)
            for n, f in zip(names, CHECKPOINT)
        ]
    )
    assert [r["batch_seq"] for r in io.latest_labels(hot).collect()] == [2999]


def test_manifest(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1)], "k string, help int")
    row = manifest(df, "help", {"raw": df}, ["k"], ["category"], ["k", "help", "gone"]).first()
    assert (row["output_rows"], row["raw_rows"], row["target_distribution"]) == (3, 3, {"0": 1, "1": 2})
    assert row["empty_columns"] == ["category"] and row["removed_columns"] == ["gone"]


# --- validation and joins --------------------------------------------------------------------------


def test_gold_assertions(spark):
    good = label(spark, [{"annotation_id": "a"}, {"annotation_id": "b"}])
    assert validate.assert_gold(good) is good
    for rows, word in [
        ([{"annotation_id": "a"}, {"annotation_id": "a"}], "duplicate_ids"),
        ([{"annotation_id": "a", "is_helpful": None}], "missing_labels"),
        ([{"annotation_id": "a", "label_source": "who"}], "unknown_sources"),
    ]:
        with pytest.raises(validate.DataCheckError, match=word):
            validate.assert_gold(label(spark, rows))
    with pytest.raises(validate.DataCheckError, match="Human"):
        validate.assert_gold(good.withColumn("manual_label", F.lit("1")))


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, None, 2, None), (1, 5, 3, None)], "a int, b int, c int, d int")
    got = {r["column"]: r["is_constant"] for r in validate.constant_columns(df, ["a", "b", "c", "d"]).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True}
    assert validate.drop_constant(df, ["a", "b"]).columns == ["b", "c", "d"]


def test_request_rules(spark):
    data = [
        ("p", "c", 5, "ok", 1.0, "b"), ("", "c", 5, "ok", None, None), ("p", "c", 6, "ok", -1.0, None),
        ("p", "c", None, " ", None, "b" * 101), ("p" * 201, None, 1, "x" * 10001, None, None),
    ]
    df = spark.createDataFrame(
        data, "product_name string, category string, rating int, review_text string, price double, brand string")
    ok, bad = validate.validate_reviews(df)
    assert ok.count() == 1
    assert sorted(sorted(r["errors"]) for r in bad.collect()) == sorted([
        ["product_name"], ["price", "rating"], ["blank_text", "brand", "rating"],
        ["category", "product_name", "review_text"],
    ])


def test_strict_label_cast_fails(spark):
    df = spark.createDataFrame([("r", "p", 1, "t", "yes")],
                               "review_id string, product_id string, rating int, review_text string, is_helpful string")
    with pytest.raises(Exception):
        validate.review_dataset(df).collect()


def test_first_rows(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 1, "")], "annotation_id string, o int, review_text string")
    assert [tuple(r) for r in validate.valid_unique(df, ["o"]).collect()] == [("a", 1, "early")]


def raw_and_labels(spark, label_ids=("1", "2")):
    raw = spark.createDataFrame(
        [(i, "p", "u", 5, "Tốt", "pin", None, 0, i == "1", None) for i in ("1", "2", "3")],
        "review_id string, product_id string, user_id string, rating int, title string, content string, "
        "created_at timestamp, helpful_count int, purchased boolean, crawled_at timestamp")
    labels = label(spark, [{"annotation_id": f"A{i}"} for i in label_ids]).withColumns({
        "review_id": F.substring("annotation_id", 2, 9), "product_id": F.lit("p"), "user_id": F.lit("u"),
        "sample_group": F.lit("g")})
    return raw, labels


def test_full_labeled(spark):
    raw, labels = raw_and_labels(spark)
    rows = gold.full_labeled(raw, labels).collect()
    assert [(r["annotation_id"], r["purchased_int"], r["word_count"], r["help"]) for r in rows] == [
        ("A1", 1, 2, 1), ("A2", 0, 2, 1)]
    assert len(rows[0]) == 29
    with pytest.raises(validate.DataCheckError, match="9"):
        gold.full_labeled(*raw_and_labels(spark, ("1", "9")))
    with pytest.raises(validate.DataCheckError, match="unique"):
        gold.full_labeled(raw.union(raw), labels)


def test_agreement_of_missing_values_is_false(spark):
    source = spark.createDataFrame([("a", "1"), ("b", None), ("c", "uncertain"), ("d", "0")], "annotation_id string, manual_label string")
    rows = gold.gold_join(source, label(spark, [{"annotation_id": "a"}, {"annotation_id": "b"}, {"annotation_id": "d"}])).collect()
    assert {r["annotation_id"]: r["agrees_with_original"] for r in rows} == {"a": True, "b": False, "c": False, "d": False}
    assert {r["annotation_id"]: r["quality_flags"] for r in rows}["c"] == []


def test_batch_audit(spark):
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "batch_id int, annotation_id string")
    given = spark.createDataFrame([(1, "a"), (1, "x"), (2, "c")], "batch_id int, annotation_id string")
    audit = {r["batch_id"]: (r["missing"], r["extra"], r["complete"]) for r in gold.batch_audit(asked, given).collect()}
    assert audit == {1: (1, 1, False), 2: (0, 0, True)}
    assert {tuple(r) for r in gold.batch_mismatches(asked, given).collect()} == {(1, "b", "missing"), (1, "x", "extra")}


# --- order, ranks, samples ----------------------------------------------------------------------------


def skewed(spark, n=3000, partitions=7):
    """A third of the rows belong to one product, and scores have many ties."""
    rng = random.Random(5)
    data = [("hot" if i % 3 == 0 else f"p{rng.randrange(40)}", rng.randrange(20) / 20, i) for i in range(n)]
    df = spark.createDataFrame(data, "product_id string, helpfulness_score double, original_index long")
    return data, df.repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 13])
def test_ranks_equal_a_plain_sort(spark, partitions):
    data, df = skewed(spark, partitions=partitions)
    ordered = sorted(data, key=lambda r: (-r[1], r[2]))
    got = {r["original_index"]: r["rank"] for r in ranking.rank_reviews(df).collect()}
    assert got == {r[2]: i for i, r in enumerate(ordered, 1)}
    seen, expected = {}, {}
    for product, _, index in ordered:
        seen[product] = seen.get(product, 0) + 1
        expected[index] = seen[product]
    rows = ranking.rank_reviews(df, ["product_id"]).collect()
    assert {r["original_index"]: r["rank"] for r in rows} == expected
    assert all(r["count"] == seen[r["product_id"]] for r in rows)


def test_positions_with_null_groups(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 1)], "g string, v int")
    rows = ordering.with_position(df, [F.col("v")], ["g"]).collect()
    assert sorted((r["g"] or "", r["v"], r["position"]) for r in rows) == [("", 1, 0), ("", 2, 1), ("a", 1, 0)]


def test_running_sums_and_totals(spark):
    data, df = skewed(spark, 600)
    keyed = df.withColumn("w", F.col("original_index") % 5)
    order = [F.col("helpfulness_score"), F.col("original_index")]
    summed = ordering.with_running_sums(keyed, order, {"s": F.col("w")}, ["product_id"], totals_as={"s": "all"})
    groups = {}
    for r in sorted(keyed.collect(), key=lambda r: (r["helpfulness_score"], r["original_index"])):
        groups.setdefault(r["product_id"], []).append(r)
    want = {}
    for rows in groups.values():
        upto = 0
        for r in rows:
            upto += r["w"]
            want[r["original_index"]] = (upto, sum(x["w"] for x in rows))
    assert {r["original_index"]: (r["s"], r["all"]) for r in summed.collect()} == want


def test_samples_are_seeded_and_sized(spark):
    _, df = skewed(spark, 300)
    one = ranking.sample_per_group(df, ["product_id"], 2, 1, "original_index")
    two = ranking.sample_per_group(df.repartition(3), ["product_id"], 2, 1, "original_index")
    other = ranking.sample_per_group(df, ["product_id"], 2, 2, "original_index")
    ids = lambda t: sorted(r["original_index"] for r in t.collect())
    assert ids(one) == ids(two) != ids(other)
    assert one.groupBy("product_id").count().agg(F.max("count")).first()[0] == 2
    assert ranking.sample_per_group(df, [], 7, key="original_index").count() == 7


def test_folds_are_balanced_and_deterministic(spark):
    _, df = skewed(spark, 301)
    df = df.withColumn("label", (F.col("product_id") == "hot").cast("int"))
    folds = ranking.stratified_folds(df, "label", 4, 9, "original_index")
    again = ranking.stratified_folds(df.repartition(2), "label", 4, 9, "original_index")
    assert sorted(map(str, folds.select("original_index", "fold").collect())) == sorted(
        map(str, again.select("original_index", "fold").collect()))
    sizes = folds.groupBy("label", "fold").count().groupBy("label").agg(
        (F.max("count") - F.min("count")).alias("gap"), F.count("*").alias("n")).collect()
    assert all(r["gap"] <= 1 and r["n"] == 4 for r in sizes)


def test_slices_are_cut_by_position(spark):
    _, df = skewed(spark, 400)
    part = ranking.work_slice(df, 50, 100, [F.col("original_index")])
    rest = ranking.work_slice(df, 390, None, [F.col("original_index")])
    ids = lambda t: sorted(r["original_index"] for r in t.collect())
    assert ids(part) == list(range(50, 150))
    assert ids(rest) == list(range(390, 400))


def test_global_top_k(spark):
    _, df = skewed(spark, 400)
    best = ranking.top_k(df, [], [F.col("original_index").desc()], 30)
    assert sorted((r["rank"], r["original_index"]) for r in best.collect()) == [(k + 1, 399 - k) for k in range(30)]


# --- statistics and metrics -------------------------------------------------------------------------------


def test_narrowed_percentiles_equal_numpy(spark):
    """Sets that are too large to sort are cut to the buckets that hold a wanted rank."""
    rng = np.random.default_rng(8)
    values = {
        "a": rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000),
        "b": np.repeat([1.5, -0.0, 7.0], 40),
        None: rng.integers(0, 900, 2000) / 7.0,
        "d": np.array([4.25]),
        "e": np.concatenate([np.full(500, -np.inf), np.arange(400.0), np.full(3, np.inf)]),
    }
    df = spark.createDataFrame([(g, float(x)) for g, xs in values.items() for x in xs] + [("a", None), ("z", None)], "g string, x double")
    wanted = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p77": 0.77, "p100": 1.0}
    got = {r["g"]: r for r in stats.percentiles_of(stats.value_levels(df, ["x"], ["g"]), wanted, ["g"], most=10).collect()}
    whole = {r["g"]: r for r in stats.exact_percentiles(df, ["x"], wanted, ["g"]).collect()}
    assert set(got) == set(values) and got == whole
    for g, xs in values.items():
        for name, p in wanted.items():
            ordered, place = np.sort(xs), p * (len(xs) - 1)
            low, high = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
            between = low if low == high else low + (high - low) * (place - np.floor(place))
            assert got[g][name] == between


def test_global_top_k_and_slices_write_only_what_a_task_could_need(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1.0, 2.0, 3.5]), f"k{i:04d}") for i in range(1000)]
    df = spark.createDataFrame(rows, "s double, k string").repartition(6)
    order = [F.col("s").desc_nulls_last(), F.col("k")]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    written = []
    real = ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda d: written.append(real(d)) or written[-1])
    for k in (0, 1, 7, 333, 2000):
        got = ranking.top_k(df, [], order, k).orderBy("rank").collect()
        assert [(r["s"], r["k"]) for r in got] == want[:k] and [r["rank"] for r in got] == list(range(1, min(k, 1000) + 1))
        assert written[-1].count() <= 6 * k
    got = ranking.work_slice(df, 20, 30, order).collect()
    assert sorted((r["k"] for r in got)) == sorted(k for _, k in want[20:50])
    assert ranking.work_slice(df, 990, None, order).count() == 10


def test_mean_does_not_depend_on_the_order_of_rows(spark):
    values = [0.1, 0.7, 1e6, 0.3, 2e-5, 0.755, 0.755] * 30
    means = set()
    for seed in range(4):
        random.Random(seed).shuffle(values)
        df = spark.createDataFrame([(1, 1, v) for v in values], "g int, help int, c double").repartition(seed + 1)
        means.add(reports.rate_report(df, "g", means={"m": ("c", 6)}).first()["m"])
    assert len(means) == 1


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.integers(0, 9, 200), "b": rng.normal(size=51), "c": np.array([3.0])}
    data = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("c", float("nan"))]
    df = spark.createDataFrame(data, "g string, x double")
    got = stats.exact_percentiles(df, ["x"], {"q": 0.25, "m": 0.5, "t": 0.99}, ["g"]).collect()
    for r in got:
        expected = np.percentile(groups[r["g"]].astype(float), [25, 50, 99])
        assert np.allclose([r["q"], r["m"], r["t"]], expected)


def test_correlations_with_gaps_and_constants(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=80) + 1e6
    y = x * 0.5 + rng.normal(size=80)
    data = [(float(a), None if i % 7 == 0 else float(b), 4.2) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "x double, y double, k double")
    matrix = {r["variable"]: r for r in reports.correlation_matrix(df, ("x", "y", "k")).collect()}
    keep = np.array([i % 7 != 0 for i in range(80)])
    assert abs(matrix["x"]["y"] - np.corrcoef(x[keep], y[keep])[0, 1]) < 6e-4
    assert matrix["x"]["x"] == 1.0 and matrix["k"]["x"] is None and matrix["k"]["k"] is None
    assert matrix["y"]["x"] == matrix["x"]["y"]


def brute_metrics(labels, scores):
    pos = [s for l, s in zip(labels, scores) if l == 1]
    neg = [s for l, s in zip(labels, scores) if l == 0]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap, tp, seen = 0.0, 0, 0
    for level in sorted(set(scores), reverse=True):
        at = [l for l, s in zip(labels, scores) if s == level]
        tp, seen = tp + sum(at), seen + len(at)
        ap += sum(at) / len(pos) * tp / seen
    return auc, ap


def test_metrics_equal_brute_force(spark):
    rng = random.Random(8)
    scores = [rng.randrange(12) / 12 for _ in range(120)]
    labels = [int(rng.random() < s) for s in scores]
    data = [(l, s, int(s >= 0.5)) for l, s in zip(labels, scores)]
    df = spark.createDataFrame(data, "label int, proba_helpful double, pred int")
    row = metrics.binary_metrics(df).first()
    auc, ap = brute_metrics(labels, scores)
    assert abs(row["roc_auc"] - auc) < 1e-12 and abs(row["pr_auc"] - ap) < 1e-12
    assert row["tp"] + row["fp"] + row["fn"] + row["tn"] == 120


def test_metrics_of_scores_that_differ_in_late_digits(spark):
    rng = random.Random(9)
    scores = [0.5 + rng.random() * 1e-9 for _ in range(200)]
    labels = [int(rng.random() < 0.4) for _ in scores]
    df = spark.createDataFrame([(l, s, 1) for l, s in zip(labels, scores)], "label int, proba_helpful double, pred int")
    row = metrics.binary_metrics(df).first()
    auc, ap = brute_metrics(labels, scores)
    assert abs(row["roc_auc"] - auc) < 1e-12 and abs(row["pr_auc"] - ap) < 1e-12


def test_metrics_of_one_class(spark):
    df = spark.createDataFrame([(0, 0.2, 0), (0, 0.9, 1)], "label int, proba_helpful double, pred int")
    row = metrics.binary_metrics(df).first()
    assert row["roc_auc"] is None and row["pr_auc"] == 0.0
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


# --- reports ---------------------------------------------------------------------------------------------------


def reviewed(spark, rows):
    return spark.createDataFrame(
        rows, "rating int, help int, word_count int, helpfulness_score int, confidence double, sample_group string")


ROWS = [(5, 1, 3, 4, 0.95, "g"), (5, 0, 5, 1, 0.7, "g"), (None, 1, 51, 5, 0.65, None), (1, 0, 0, 0, 1.0, "h")]


def test_null_keys(spark):
    df = reviewed(spark, ROWS)
    assert {r["rating"] for r in reports.by_rating(df).collect()} == {1, 5}
    assert {r["rating"] for r in reports.by_rating(df, keep_null=True).collect()} == {None, 1, 5}


def test_empty_buckets_stay(spark):
    rows = reports.by_length(reviewed(spark, ROWS)).orderBy("bucket_order").collect()
    assert [(r["length_bucket"], r["review_count"]) for r in rows] == [
        ("1-5", 3), ("6-10", 0), ("11-20", 0), ("21-50", 0), ("51+", 1)]
    assert rows[1]["helpful_rate"] is None and rows[0]["helpful_rate"] == 33.33


def test_confidence_buckets_are_left_closed(spark):
    rows = reports.by_confidence(reviewed(spark, [*ROWS, (1, 1, 1, 1, 1.5, "g")])).orderBy("bucket_order").collect()
    assert [r["review_count"] for r in rows] == [1, 1, 0, 2]
    assert [r["percentage"] for r in rows] == [20.0, 20.0, 0.0, 40.0]


def test_reports_of_an_empty_table(spark):
    df = reviewed(spark, [])
    assert reports.by_rating(df).count() == 0
    assert [r["review_count"] for r in reports.by_length(df).collect()] == [0] * 5
    assert reports.rule_accuracy(df).first()["rule_accuracy"] is None
    assert reports.missing_report(df).filter("missing_rate_pct is not null").count() == 0


def test_flags_as_text(spark):
    df = spark.createDataFrame([('["a","b"]', 1), ("[]", 0), ("broken", 1), (None, 0), ('["a"]', 0)], "quality_flags string, help int")
    got = {r["flag"]: (r["occurrence_count"], r["helpful_rate"]) for r in reports.flag_summary(df).collect()}
    assert got == {"no_flag": (3, 33.33), "a": (2, 50.0), "b": (1, 100.0)}


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([("1", "x", 1), ("1", "x", 0), (None, None, 2), (None, "", None)],
                               "review_id string, review_context string, help int")
    row = reports.quality_counters(df).first()
    assert (row["duplicate_id"], row["duplicate_text"], row["empty_text"], row["label_outside_01"]) == (2, 1, 1, 2)


def test_word_frequencies(spark):
    df = spark.createDataFrame([("Pin, pin TỐT và 2024 https://x.y", 1), ("pin", 0)], "review_context string, help int")
    got = {(r["help"], r["word"]): r["count"] for r in reports.word_frequencies(df).collect()}
    assert got == {(1, "pin"): 2, (1, "tốt"): 1, (0, "pin"): 1}


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double")
    assert [(r["bin"], r["count"]) for r in reports.histogram(df, "x", 10).collect()] == [(0, 2)]


def test_agreement_counts_missing_as_wrong(spark):
    df = spark.createDataFrame([(1, 1), (None, None), (0, None), (0, 1)], "a int, b int")
    assert reports.agreement(df, "a", "b").first()["agreement"] == 0.25


def test_sketches_merge_over_batches_and_reruns(spark, tmp_path):
    rng = np.random.default_rng(5)
    values = rng.lognormal(3, 1, 30_000)
    rows = [(int(k % 3), f"u{rng.integers(0, 4000)}", float(x)) for k, x in enumerate(values)]
    df = spark.createDataFrame(rows, "b int, u string, x double")
    path = str(tmp_path / "s")
    for b in (0, 1, 2, 1):
        sketches.store(sketches.sketched(df.where(F.col("b") == b), ["u"], ["x"]), path, f"b{b}")
    kept = sketches.stored(spark, path)
    users = sketches.distinct_counts(kept).first()
    assert users["rows"] == 30_000 and abs(users["estimate"] - len({u for _, u, _ in rows})) < 0.05 * 4000
    got = sketches.quantile_values(kept, {"p1": 0.01, "p50": 0.5, "p99": 0.99}).first()
    for name, p in (("p1", 0.01), ("p50", 0.5), ("p99", 0.99)):
        assert abs((values <= got[name]).mean() - p) < 0.01
    nothing = sketches.sketched(df.where("false"), ["u"], ["x"])
    assert sketches.distinct_counts(nothing).first()["estimate"] == 0
    assert sketches.quantile_values(nothing, {"m": 0.5}).first()["m"] is None
    mixed = spark.createDataFrame([(None,), (float("nan"),), (2.0,)], "x double")
    assert sketches.quantile_values(sketches.sketched(mixed, [], ["x"]), {"m": 0.5}).first()["m"] == 2.0
