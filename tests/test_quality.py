from offerrank.operators import quality, reports
from offerrank.operators.profile import feature_stats, histogram, monitor_stats
from pyspark.sql import functions as F


def found(df):
    return {r.check: r.n for r in df.collect()}


def test_members(spark):
    ids = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,), (None,)], "member_id STRING")
    assert found(quality.validate_members(ids)) == {"duplicate_ids": 3, "null_ids": 2}
    assert found(quality.validate_members(ids.where("false"), ["member_id", "x"])) == {"missing_columns": 1, "empty": 1}
    assert found(quality.validate_members(spark.range(3).toDF("x"))) == {"missing_columns": 1}
    assert found(quality.validate_members(ids.where("member_id = 'b'"))) == {}


def test_features(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", float("-inf"), None), ("c", None, 1)], "t STRING, x DOUBLE, y INT")
    got = {tuple(r) for r in quality.validate_features(df, ["x", "z"]).collect()}
    assert got == {("missing", "z"), ("infinite", "x"), ("high_null_rate", "y")}


def test_drift_with_zero_baseline_and_lost_column(spark, tmp_path):
    old = spark.createDataFrame([(0.0, 10.0, 1.0)], "zero DOUBLE, ten DOUBLE, lost DOUBLE")
    monitor = quality.DriftMonitor(str(tmp_path / "base"))
    monitor.set_baseline(old)
    new = spark.createDataFrame([(0.2, 11.0)], "zero DOUBLE, ten DOUBLE")
    got = {r.feature: (round(r.mean_change, 6), r.has_drift) for r in monitor.check(new).collect()}
    assert got == {"zero": (0.2, True), "ten": (0.1, False)}


def test_stats_of_no_rows(spark):
    empty = spark.createDataFrame([], "x DOUBLE")
    assert [tuple(r) for r in monitor_stats(empty, ["x"]).collect()] == [("x", None, None, None, None, None)]
    assert [(r.feature, r["count"]) for r in feature_stats(empty, ["x"]).collect()] == [("x", 0)]


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 5.0, 10.0)], "x DOUBLE")
    assert {r["bin"]: r.n for r in histogram(df, F.col("x"), 2).collect()} == {0: 2, 1: 2}
    flat = spark.createDataFrame([(3.0,), (3.0,)], "x DOUBLE")
    assert [(r["bin"], r.n) for r in histogram(flat, F.col("x"), 5).collect()] == [(0, 2)]


def test_age_groups_keep_empty_bins(spark):
    recs = spark.createDataFrame([("a",), ("a",), ("b",), ("x",)], "member_id STRING")
    members = spark.createDataFrame([("a", 35), ("b", 101)], "member_id STRING, age INT")
    got = {r.age_group: r.n for r in reports.recs_by_age_group(recs, members).collect()}
    assert got == {"<35": 2, "35-50": 0, "50-65": 0, "65+": 0}
