import json

from pyspark.sql import functions as F

from reviewsift.operators import explain, responses
from reviewsift.plans import flows
from reviewsift.sources.io import read_checkpoint


def item(annotation_id="manual_1", **changes):
    base = {
        "annotation_id": annotation_id, "is_helpful": 0, "confidence": 0.9, "reason": " a  b ",
        "evidence": {"specificity": 1, "product_experience": 1, "decision_value": 0, "clarity": 1,
                     "noise_penalty": 0},
        "quality_flags": ["shipping_only", "made_up"],
    }
    evidence = changes.pop("evidence", None)
    base.update(changes)
    if isinstance(evidence, dict):
        base["evidence"] = {**base["evidence"], **evidence}
    elif evidence is not None:
        base["evidence"] = evidence
    return base


def parse(spark, *bodies):
    data = [(i, b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(data, "batch_id long, response_text string")
    items = responses.explode_responses(df)
    rows = responses.parsed_labels(items).orderBy("batch_id", "item_index").collect()
    return rows


def test_every_response_shape(spark):
    fenced = "```json\n" + json.dumps([item()]) + "\n```"
    rows = parse(
        spark, {"labels": [item(), item("x")]}, [item()], fenced, item(), {"n": 1, "out": [item()]},
        "{oops", {"nothing": []}, None,
    )
    by_batch = {}
    for r in rows:
        by_batch.setdefault(r["batch_id"], []).append(r["reject_reason"])
    assert by_batch == {
        0: [None, None], 1: [None], 2: [None], 3: [None], 4: [None],
        5: ["invalid_json"], 6: ["no_labels"], 7: ["invalid_json"],
    }


def test_normalised_values(spark):
    (row,) = parse(spark, [item()])
    assert row["annotation_id"] == "MANUAL_00001"
    assert (row["helpfulness_score"], row["is_helpful"], row["confidence"]) == (3, 0, 0.79)
    assert row["quality_flags"] == ["ambiguous", "shipping_only"] and row["needs_human_review"]
    assert row["reason"] == "a b" and row["label_source"] == "llm"


def test_label_follows_the_score(spark):
    high = item(evidence={"specificity": 2, "product_experience": 2})
    low = item(is_helpful=1, evidence={"specificity": 0})
    low["evidence"]["product_experience"] = 0
    a, b = parse(spark, [high], [low])
    assert (a["helpfulness_score"], a["is_helpful"], a["confidence"]) == (5, 1, 0.9)
    assert (b["helpfulness_score"], b["is_helpful"]) == (1, 0)


def test_python_like_numbers_and_rejects(spark):
    rows = parse(
        spark,
        [item(evidence={"specificity": "1", "clarity": 1.7})],
        [item(evidence={"specificity": 3})],
        [item(evidence={"clarity": None})],
        [item(evidence={"clarity": "x"})],
        [item(evidence="none")],
        [item(is_helpful=2)],
        [item(confidence=None)],
        [item(confidence="high")],
        [item(confidence=7)],
        [{k: v for k, v in item().items() if k != "confidence"}],
        [item(quality_flags="shipping_only")],
        [3],
        [{k: v for k, v in item().items() if k != "annotation_id"}],
    )
    reasons = [r["reject_reason"] for r in rows]
    assert reasons == [
        None, "bad_specificity", "bad_clarity", "bad_clarity", "missing_evidence", "bad_is_helpful",
        "bad_confidence", "bad_confidence", None, None, None, "not_an_object", "missing_annotation_id",
    ]
    assert rows[8]["confidence"] == 0.79 and rows[9]["confidence"] == 0.5
    assert rows[10]["quality_flags"] == ["ambiguous"]


def source(spark, n):
    data = [(f"MANUAL_{i:05d}", f"r{i}", "p", 5, 0, "Tốt", "so với loại cũ", "g") for i in range(n)]
    return spark.createDataFrame(
        data, "annotation_id string, review_id string, product_id string, rating int, "
        "purchased_int int, title string, content string, sample_group string")


def test_request_accept_retry_resume(spark, tmp_path):
    rows = source(spark, 5).withColumn("manual_label", F.lit("1"))
    requests = flows.next_requests(rows, None, batch_size=2)
    assert [r["n_records"] for r in requests.orderBy("batch_id").collect()] == [2, 2, 1]
    asked = requests.select(
        "batch_id", F.explode(F.from_json("records", "array<struct<annotation_id:string>>")).alias("r")
    ).select("batch_id", "r.annotation_id")
    answers = spark.createDataFrame(
        [
            (0, json.dumps({"labels": [item("MANUAL_00000"), item("manual_1")]})),
            (1, json.dumps([item("MANUAL_00002"), item("MANUAL_00099")])),
            (2, "no json"),
        ],
        "batch_id long, response_text string",
    )
    path = str(tmp_path / "checkpoint")
    out = flows.accept_responses(asked, answers, rows, path, 0)
    status = {r["batch_id"]: (r["missing"], r["extra"], r["batch_ok"]) for r in out["status"].collect()}
    assert status[0] == (0, 0, True) and status[1] == (1, 1, False)
    assert not status[2][2]
    retries = {(r["annotation_id"], r["retry_batch_id"], r["exhausted"]) for r in out["retries"].collect()}
    assert retries == {
        ("MANUAL_00002", "1/MANUAL_00002", False), ("MANUAL_00003", "1/MANUAL_00003", False),
        ("MANUAL_00004", "2", True),
    }
    done = read_checkpoint(spark, path)
    assert {r["annotation_id"] for r in done.collect()} == {"MANUAL_00000", "MANUAL_00001"}
    assert all("contains_comparison" in r["quality_flags"] for r in done.collect())
    left = flows.next_requests(rows, done, batch_size=20)
    assert left.first()["n_records"] == 3
    result = flows.gold_outputs(rows, path)
    assert result["gold"].count() == 5
    totals = {r["key"]: r["value"] for r in result["report"].filter("section = 'totals'").collect()}
    assert totals["labeled_rows"] == 2 and totals["unlabeled_rows"] == 3


def test_weighted_quality_golden_value(spark):
    names = list(explain.QUALITY_WEIGHTS)
    data = [(60, 50, 70, 40, 55, 120), (-5, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(data, ", ".join(f"{n} int" for n in names))
    got = [r[0] for r in explain.quality_from_scores(df, {n: n for n in names}).select("information_quality_score").collect()]
    assert got == [61.8, 0.0]


def explained(spark):
    data = [
        (0.9, ["specific_experience", "sufficient_detail"], json.dumps({
            "why": ["x"], "strengths": "text", "score_interpretation": {"label": "Wrong", "explanation": "e"},
            "rubric_scores": {"specificity": 150, "balance": "bad"},
            "rubric_details": {"specificity": {"evidence": "q"}}})),
        (0.2, ["too_generic"], "[1]"),
        (0.2, [], None),
    ]
    df = spark.createDataFrame(data, "p double, model_reason_codes array<string>, remote_json string")
    return explain.explain_local(explain.decide(df, "p"))


def test_local_explanations(spark):
    good, generic, none = [r["explanation"] for r in explained(spark).collect()]
    assert len(good["why"]) == 2 and good["strengths"] == good["why"] and good["limitations"] == []
    assert good["quality_assessment"]["information_quality_score"] == 59.4
    assert generic["quality_assessment"]["information_quality_score"] == 20.0
    assert len(none["why"]) == 1 and none["evidence_analysis"] == []
    assert len(none["missing_information"]) == 3


def test_remote_explanations_never_change_the_decision(spark):
    remote, array, none = [r["explanation"] for r in explain.merge_explanations(explained(spark)).collect()]
    assert remote["score_interpretation"]["label"] == "Helpful"
    assert remote["score_interpretation"]["explanation"] == "e"
    assert remote["why"] == ["x"] and len(remote["strengths"]) == 2
    assert remote["quality_assessment"]["information_quality_score"] == 20.0
    assert remote["quality_assessment"]["dimensions"][0]["evidence"] == "q"
    assert (remote["source"], none["source"]) == ("remote", "local_fallback")
    assert array["source"] == "local_fallback_after_remote_error"


def test_response_status(spark):
    data = [
        (200, None, "STOP", "{}", None), (429, None, None, None, "remote_http_429"),
        (None, "http", None, None, "remote_http_error"), (None, "timeout", None, None, "remote_timeout"),
        (None, "connection", None, None, "remote_connection_error"),
        (200, None, "MAX_TOKENS", "{}", "remote_max_tokens"), (200, None, None, "{x", "remote_invalid_json"),
        (200, None, None, "[1]", "remote_response_error"), (200, None, None, None, "remote_response_error"),
    ]
    df = spark.createDataFrame(
        data, "http_status int, error_kind string, finish_reason string, response_text string, expected string")
    assert explain.response_status(df).filter(~F.col("fallback_reason").eqNullSafe(F.col("expected"))).count() == 0


def test_confidence_levels_at_the_edges(spark):
    df = spark.createDataFrame([(0.85,), (0.15,), (0.7,), (0.3,), (0.5,)], "p double")
    got = [r["confidence_level"] for r in explain.decide(df, "p").collect()]
    def level(p):
        d = abs(p - 0.5)
        return "High" if d >= 0.35 else "Medium" if d >= 0.2 else "Low"
    assert got == [level(p) for p in (0.85, 0.15, 0.7, 0.3, 0.5)]
