"""Registered queries against their SQL on the smallest supplied tables."""

import inspect

import pytest

import __spark_entry__ as entry
from reviewsift.models.stack import Settings
from reviewsift.plans import catalog
from reviewsift.session import shared_dir
from tools.check_oracle import compare, connect

# Chains of many short jobs: smaller settings here, the full smoke mode in tools/check_oracle.py.
BOOSTED = ("m5_boosted_trees", "m11_outer_cv", "m15_train_and_predict")
SMALL_MODE = Settings(outer_folds=3, inner_folds=2, trees=10, rf_depth=8, rounds=8, step=0.3, boost_depth=5, logistic_iterations=50)
CHECKED = tuple(catalog.ORACLE)


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, small, con, name, monkeypatch):
    if name in BOOSTED:
        monkeypatch.setattr(catalog, "MODE", SMALL_MODE)
    df = entry.queries()[name](spark, small)
    assert compare(df, con.sql(entry.oracle_sql()[name])) == ""


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_query(spark, small):
    assert entry.entry(spark).count() == 5


def test_partition_count_does_not_change_results(spark, small):
    def run():
        return sorted(map(str, entry.queries()["w1_rank_global"](spark, small).collect()))

    before = run()
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert run() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_shared_folder_comes_from_the_session(spark):
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return "/shared/x/" if key == "spark.checkpoint.dir" else default

    assert shared_dir(Session) == "/shared/x"
    assert "localCheckpoint" not in inspect.getsource(inspect.getmodule(shared_dir))
