"""Hand-computed rows for the rules that are easy to get wrong."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from offerrank import fixed_values as fv
from offerrank.functions.scalar import bin_label, elapsed_days, round_even, safe_bool, safe_float, safe_int, title_case
from offerrank.operators import features as fx
from offerrank.operators.encode import LabelEncoder
from offerrank.session import materialize
from offerrank.sources.tables import SCHEMAS

REF = datetime(2001, 11, 5, 12)


def values(df, column):
    return [r[column] for r in df.collect()]


def test_bins_are_right_closed(spark):
    ages = spark.createDataFrame([(a,) for a in (0, 1, 26, 27, 65, 66, 100, 101, None)], "a INT")
    got = values(ages.select(bin_label(F.col("a"), fv.AGE_BINS, fv.AGE_LABELS).alias("g")), "g")
    assert got == ["nan", "18-25", "18-25", "26-35", "51-65", "65+", "65+", "nan", "nan"]


def test_elapsed_days_are_not_calendar_days(spark):
    df = spark.createDataFrame([("2001-11-04 13:00:00",), ("2001-11-04 12:00:00",), ("2001-11-05 12:00:01",)], "t STRING")
    assert values(df.select(elapsed_days(REF, F.col("t").cast("timestamp")).alias("d")), "d") == [0, 1, -1]


def test_round_even_goes_by_the_stored_number(spark):
    df = spark.createDataFrame([(0.125,), (0.575,), (2.5,)], "x DOUBLE")
    assert values(df.select(round_even(F.col("x"), 2).alias("y")), "y") == [0.12, 0.57, 2.5]


def test_safe_casts(spark):
    df = spark.createDataFrame([("12.9",), ("-3.9",), ("x",), (None,), ("NaN",), ("YES",)], "t STRING")
    rows = df.select(safe_float(F.col("t")), safe_int(F.col("t")), safe_bool(F.col("t"))).collect()
    assert [r[1] for r in rows] == [12, -3, 0, 0, 0, 0]
    assert [r[0] for r in rows][:4] == [12.9, -3.9, 0.0, 0.0]
    assert [r[2] for r in rows] == [False] * 5 + [True]


def test_title_case(spark):
    assert spark.range(1).select(title_case(F.lit("claims last 30d q4"))).first()[0] == "Claims Last 30D Q4"


def claim(member, claim_id, when, kind="lab", dx="diabetes", amount=100.0):
    return (claim_id, member, datetime.fromisoformat(when), kind, dx, amount, amount, 80.0, 20.0, None, True, "paid", None)


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    """Half a cent must fall the same way on any layout: the sum is that of exact arithmetic."""
    amounts = [round(1234.5678 * (k * 7919 % 1000 + 1) / 1000 + 10 ** (k % 6), 4) for k in range(3000)]
    want = math.fsum(amounts)
    for order in (amounts, amounts[::-1], sorted(amounts)):
        rows = spark.createDataFrame([(a,) for a in order], "a DOUBLE").coalesce(1)
        assert rows.agg(fx.exact_sum("a")).first()[0] == want
    odd = spark.createDataFrame([(1, float("inf")), (1, 2.0), (2, None), (3, 0.5), (3, None)], "k INT, a DOUBLE")
    assert {r[0]: r[1] for r in odd.groupBy("k").agg(fx.exact_sum("a")).collect()} == {1: float("inf"), 2: None, 3: 0.5}


def test_total_member_cost_is_exact(spark):
    amounts = [round(1234.5678 * (k * 7919 % 1000 + 1) / 1000 + 10 ** (k % 6), 4) for k in range(3000)]
    rows = [(str(k), "a", None, "lab", "x", a, a, a, a, None, True, "paid", None) for k, a in enumerate(amounts)]
    row = fx.claim_features(spark.createDataFrame(rows, SCHEMAS["claims"]).coalesce(1), REF).first()
    assert row["total_member_cost"] == row["total_paid_amount"] == row["total_claims_amount"] == math.fsum(amounts)
    assert row["avg_member_cost"] == math.fsum(amounts) / 3000


@pytest.mark.parametrize("unlisted,passes", [(["odd", "odd"], 1), (["odd", "rare", "new"], 2)])
def test_claims_are_read_again_only_for_several_unlisted_diagnoses(spark, monkeypatch, unlisted, passes):
    rows = [claim("a", str(k), "2001-10-06T12:00:00", dx=d) for k, d in enumerate(["diabetes", *unlisted])] + [claim("b", "9", "2001-10-06T12:00:00")]
    empty = {n: spark.createDataFrame([], SCHEMAS[n]) for n in ("benefits", "engagement")}
    members = spark.createDataFrame([("a",), ("b",), ("c",)], "member_id STRING")
    members = members.select("member_id", *[F.lit(None).cast(t).alias(n) for n, t in spark.createDataFrame([], SCHEMAS["members"]).dtypes[1:]])
    claims, written = spark.createDataFrame(rows, SCHEMAS["claims"]), []
    monkeypatch.setattr(fx, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    engaged = fx.engagement_features(empty["engagement"], REF)
    got = fx.written_features(members, claims, empty["benefits"], engaged, REF)
    want = fx.join_features(members, claims, empty["benefits"], engaged, REF)
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len(written) == passes
    counts = {r["member_id"]: (r["unique_diagnosis_count"], r["is_complex_patient"]) for r in got.collect()}
    assert counts == {"a": (1 + len(set(unlisted)), int(len(set(unlisted)) >= 2)), "b": (1, 0), "c": (None, None)}


def test_claims(spark):
    rows = [claim("a", "1", "2001-10-06T12:00:00"), claim("a", "2", "2001-10-06T11:59:59", dx="new disease"),
            claim("a", "3", "2002-01-01T00:00:00", dx="oncology"), claim("b", "4", "1999-01-01T00:00:00")]
    got = {r["member_id"]: r for r in fx.claim_features(spark.createDataFrame(rows, SCHEMAS["claims"]), REF).collect()}
    a, b = got["a"], got["b"]
    assert (a["claims_last_30d"], a["claims_last_90d"]) == (2, 3)  # bound included, future rows count
    assert a["days_since_last_claim"] == -57
    assert a["unique_diagnosis_count"] == 3 and a["is_complex_patient"] == 1  # undeclared diagnosis counts
    assert b["std_claim_amount"] is None and b["claims_last_365d"] is None
    assert b["claim_frequency_trend"] == 0.0 and b["cost_per_claim"] == 50.0
    assert a["lab_visit_count"] == 3 and a["imaging_visit_count"] == 0


def test_preferred_channel_tie_is_alphabetical(spark):
    rows = [(str(i), "a", datetime(2001, 11, 1), ch, "app_open", None, None, None, None)
            for i, ch in enumerate(["sms", "email", "sms", "email", "app"])]
    row = fx.engagement_features(spark.createDataFrame(rows, SCHEMAS["engagement"]), REF).first()
    assert row["preferred_channel"] == "email"
    assert row["sms_engagement_rate"] == pytest.approx(2 / 6)
    assert row["avg_response_rate"] is None and row["engagement_trend"] == pytest.approx(5 / 6 * 12)


def test_last_day_of_year(spark):
    row = spark.range(1).select(
        *[c.alias(n) for n, c in fx.temporal_features(datetime(2001, 12, 31, 8)).items()]).first()
    assert row["days_until_year_end"] == -1 and row["benefits_urgency"] == 1 + 1 / 365


def test_fill_follows_the_name(spark):
    names = ["x_count", "rate_total", "a_rate", "b_pct", "days_since_x", "other"]
    df = spark.createDataFrame([(1.0,) * 6, (4.0,) * 6, (None,) * 6], ", ".join(f"{n} DOUBLE" for n in names))
    filled = fx.fill_missing(df, names).collect()[2]
    assert list(filled) == [0.0, 0.0, 2.5, 2.5, 365.0, 0.0]


def test_empty_median_column_stays_null(spark):
    df = spark.createDataFrame([(None, 1.0)], "a_rate DOUBLE, b DOUBLE")
    assert fx.fill_missing(df, ["a_rate", "b"]).first()["a_rate"] is None


def test_encoder(spark):
    df = spark.createDataFrame([(">150K",), ("<30K",), ("100K",), (None,)], "v STRING")
    enc = LabelEncoder.fit(df, ["v"])
    assert [r.value for r in enc.codes.orderBy("code").collect()] == ["100K", "<30K", ">150K", "None"]
    assert {r.v: r.v_encoded for r in enc.encode(df, ["v"]).collect()} == {">150K": 2, "<30K": 1, "100K": 0, None: 3}
    assert {r.v: r.v_encoded for r in enc.encode(df, ["v"], keep_null=["v"]).collect()}[None] is None
    assert {r.v_encoded for r in LabelEncoder(enc.codes).encode(df, ["v"]).collect()} == {0, 1, 2, 3}
    with pytest.raises(Exception, match="unseen label"):
        enc.encode(spark.createDataFrame([("new",)], "v STRING"), ["v"]).collect()


def test_encoder_of_many_labels(spark):
    df = spark.range(1001).select(F.format_string("%05d", "id").alias("v"), "id")
    assert LabelEncoder.fit(df, ["v"]).encode(df, ["v"]).where("v_encoded = id").count() == 1001


def test_few_labels_need_no_join(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "v STRING, id INT")
    encoded = LabelEncoder.fit(df, ["v"]).encode(df, ["v"])
    assert "Join" not in encoded._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.v_encoded for r in encoded.collect()} == {1: 2, 2: 1, 3: 0}


def test_code_too_long_for_the_compiler_is_not_run_whole(spark, pipeline):
    """The JVM only interprets methods of over 8,000 bytes."""
    assert pipeline.features is not None and int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000


def test_columns(pipeline):
    assert len(fx.FEATURES) == 96 and len(set(fx.FEATURES)) == 96
    assert pipeline.features.columns == ["member_id", *fx.FEATURES]
    assert pipeline.features.count() == pipeline.tables["members"].count()
