import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from reviewsift.plans import views as v
from reviewsift.streaming import checkpointing as cp
from reviewsift.streaming.scoring import batch_files, read_review_stream, score_rows, score_stream

COLUMNS = ["annotation_id", "review_id", "product_id", "title", "content", "manual_label"]


def rows_of(df):
    shown = df.select("annotation_id", "is_helpful", "confidence", F.to_json("quality_flags"),
                      "quality_assessment.information_quality_score")
    return sorted(map(tuple, shown.collect()))


def test_stream_equals_batch_and_resumes(spark, small, tmp_path):
    source = v.reviews(spark, small).select(*COLUMNS)
    half = F.xxhash64("annotation_id") % 2 == 0
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    source.filter(half).write.parquet(inbox)

    def run():
        stream = read_review_stream(spark, inbox, source.schema)
        score_stream(stream, out, state, v.TEST_LEXICON).awaitTermination()
        return spark.read.parquet(out)

    first = run().count()
    assert first == source.filter(half).count()
    source.filter(~half).write.mode("append").parquet(inbox)
    everything = run()
    assert everything.count() == source.count()
    assert rows_of(everything) == rows_of(score_rows(source, v.TEST_LEXICON))


def test_model_decisions_are_added(spark, small):
    source = v.reviews(spark, small).select(*COLUMNS)
    model = lambda df: df.withColumn("probability_helpful", F.lit(0.9))
    row = score_rows(source, model=model).select("label", "model_score", "confidence_level").first()
    assert tuple(row) == ("Helpful", 0.9, "High")


def arrivals(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, "annotation_id string, content string").coalesce(1).write.mode(mode).parquet(path)


def marked(mark):
    """Labels that tell which run has made them."""
    def label(rows):
        names = [f for f in cp.CHECKPOINT.fields if f.name not in ("annotation_id", "reason", "batch_seq")]
        return rows.select("annotation_id", F.lit(mark).alias("reason"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in names])

    return label


def test_batches_are_committed_exactly_once(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    arrivals(spark, [("a", "x"), ("b", "x")], inbox)
    arrivals(spark, [("c", "x"), ("b", "again")], inbox)

    def run(mark, at=state, lost=None):
        def lose(number):
            if number == lost:
                raise RuntimeError("lost")

        stream = read_review_stream(spark, inbox, spark.read.parquet(inbox).schema, 1)
        cp.label_stream(stream, out, at, marked(mark), lose).awaitTermination()

    def found():
        return {r["annotation_id"]: r["reason"] for r in cp.read_committed(spark, out).collect()}

    assert cp.read_committed(spark, out).count() == cp.commit_log(spark, out).count() == 0
    with pytest.raises(StreamingQueryException):
        run("one", lost=0)
    # Written, but not committed: nobody sees it, then or later.
    assert spark.read.json(f"{out}/data").count() == 2
    assert found() == {}
    with pytest.raises(StreamingQueryException):
        run("two", lost=1)
    first = found()
    assert set(first.values()) == {"two"} and len(first) == 2
    run("three")
    everything = found()
    assert set(everything) == {"a", "b", "c"} and all(everything[k] == "two" for k in first)
    # A new stream over the same files, and later arrivals: only unknown ids are labelled.
    arrivals(spark, [("a", "late"), ("d", "x")], inbox)
    run("four", str(tmp_path / "other"))
    assert found() == {**everything, "d": "four"}
    run("five")
    assert found() == {**everything, "d": "four"}
    log = cp.commit_log(spark, out)
    assert log.agg(F.sum("rows")).first()[0] == 4 and log.count() == 6


def test_a_committed_batch_writes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", "x")], "annotation_id string, content string")
    assert cp.append_once(marked("one")(rows), out, "s-0", 0)
    assert not cp.append_once(marked("two")(rows), out, "s-0", 0)
    assert [r["reason"] for r in cp.read_committed(spark, out).collect()] == ["one"]
    assert cp.append_once(marked("three")(rows), out, "s-1", 1)
    assert [r["reason"] for r in cp.read_committed(spark, out).collect()] == ["three"]
    assert cp.append_once(marked("four")(rows.limit(0)), out, "s-2", 2)
    assert cp.commit_log(spark, out).count() == 3


def test_files_of_a_batch_grow_with_the_table(spark):
    assert [batch_files(spark.range(n), 3) for n in (0, 1, 30_000, 30_001, 900_000)] == [1, 1, 1, 2, 30]
