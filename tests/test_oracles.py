"""Every query with DuckDB SQL gives the same names, types and rows."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from offerrank.plans import queries as registry
from offerrank.sources.fixtures import fixture

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal(name, spark, sf, duck):
    assert difference(entry.queries()[name](spark, sf), ORACLES[name], duck) is None


def test_every_query_is_known():
    without = set(registry.queries()) - set(ORACLES)
    assert without == {"gbt_train_metrics", "gbt_recommendations", "feature_importance", "tree_explanations",
                       "challenger_metrics", "model_consolidated", "model_export", "feature_group_importance", "model_factor_display"}
    assert not set(ORACLES) - set(entry.queries())


@pytest.mark.parametrize("view,source,times", [("members", "customer", 1), ("claims", "lineitem", 1), ("benefits", "customer", 7),
                                               ("engagement", "events", 1), ("feedback", "orders", 1)])
def test_views_have_all_rows(spark, sf, view, source, times):
    assert fixture(spark, sf, view).count() == times * spark.read.parquet(f"{sf}/{source}.parquet").count()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["member_id", "rank", "offer_id", "offer_name", "category", "priority_score", "description"]
    assert df.count() > 0
