from pyspark.sql import functions as F

from reviewsift.operators.rubric import rubric_score
from reviewsift.plans import flows, views as v


def test_gold_reports_run_on_one_narrow_table(spark, small):
    gold = v.gold(spark, small)
    out = flows.gold_reports(gold)
    sizes = {name: df.count() for name, df in out.items()}
    assert sizes["summary"] == 1 and sizes["length_analysis"] == 5
    assert sizes["correlation_matrix"] == 11 and sizes["label_distribution"] == 2
    row = out["summary"].first()
    assert row["rows"] == gold.count() and row["columns"] == len(gold.columns)
    assert row["missing_content"] == 0


def test_exploration_reports(spark, small):
    out = flows.exploration_reports(v.gold(spark, small))
    assert out["weekday_summary"].count() == 7
    assert out["vote_effect"].agg(F.sum("review_count")).first()[0] == out["overview"].first()["rows"]
    assert out["length_effect"].count() == 6


def test_score_and_rank_quarantines_bad_requests(spark, small):
    requests = v.requests(spark, small)

    def score(rows):
        labels = rubric_score(
            rows.withColumns({"title": F.lit(""), "content": F.col("review_text")}),
            v.TEST_LEXICON, keep=("category", "original_index"),
        )
        return labels.select("annotation_id", "category", "original_index", "helpfulness_score")

    ranked, bad = flows.score_and_rank(requests, score, ["category"])
    assert ranked.count() + bad.count() == requests.count()
    top = ranked.groupBy("category").agg(F.max("rank").alias("last"), F.max("count").alias("n"))
    assert top.filter("last <> n").count() == 0
