import random
from datetime import datetime, timedelta

import pytest

from offerrank.operators import feedback as fb

SCHEMA = "feedback_id BIGINT, member_id STRING, offer_id STRING, feedback STRING, feedback_time TIMESTAMP"


def fold(score, kinds):
    for kind in kinds:
        score = min(100, score + 15) if kind == "approved" else max(0, score - 20)
    return score


def test_newest_first_order_matters(spark):
    rows = [(1, "a", "x", "approved", datetime(2001, 1, 1)), (2, "a", "x", "rejected", datetime(2001, 1, 2))]
    scores = spark.createDataFrame([("a", "x", 95.0), ("a", "y", 50.0)], "member_id STRING, offer_id STRING, score DOUBLE")
    got = {r.offer_id: r.adjusted_score for r in fb.adjust_targets(scores, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"x": 90.0, "y": 50.0}  # 95 - 20 + 15; oldest first would give 80


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_fold_equals_brute_force_with_a_hot_pair(spark, batch):
    rnd = random.Random(3)
    rows = [(i, "hot" if rnd.random() < 0.4 else f"m{rnd.randrange(20)}", rnd.choice("xyz"),
             rnd.choice(["approved", "rejected"]), datetime(2001, 1, 1) + timedelta(hours=rnd.randrange(50)))
            for i in range(1500)]
    pairs = sorted({(r[1], r[2]) for r in rows}) + [("nobody", "x")]
    scores = spark.createDataFrame([(m, o, float(rnd.randrange(101))) for m, o in pairs],
                                   "member_id STRING, offer_id STRING, score DOUBLE")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = fb.adjust_targets(scores, spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(pairs)
    for r in got:
        mine = sorted((x for x in rows if x[1:3] == (r.member_id, r.offer_id)), key=lambda x: (x[4], x[0]), reverse=True)
        assert r.adjusted_score == fold(r.score, [x[3] for x in mine])


def test_oversampling(spark):
    data = spark.createDataFrame([(f"m{i}",) for i in range(10)], "member_id STRING")
    given = spark.createDataFrame([("m1",), ("m1",), ("m2",), ("zz",)], "member_id STRING")
    rows = fb.oversample_feedback(data, given, weight=0.9).collect()  # int(9) // 2 = 4 copies
    assert len(rows) == 8 + 2 * 4
    assert {r.sample_weight for r in rows if r.member_id in ("m1", "m2")} == {2.0}
    assert {r.sample_weight for r in rows if r.member_id not in ("m1", "m2")} == {1.0}
    unmatched = fb.oversample_feedback(data, given.where("member_id = 'zz'")).collect()
    assert len(unmatched) == 10 and {r.sample_weight for r in unmatched} == {1.0}


def test_empty_stats(spark):
    row = fb.feedback_stats(spark.createDataFrame([], SCHEMA)).first()
    assert (row.total, row.approved, row.unique_members, row.approval_rate) == (0, 0, 0, 0.0)


@pytest.mark.parametrize("others, better, champion", [
    ([], True, None), ([(1, "champion", 5.0, 0.5)], False, 1), ([(1, "champion", 7.0, 0.5)], True, 1),
    ([(1, "champion", 5.0, 0.48)], True, 1), ([(1, None, 5.0, 0.5), (2, None, 9.0, 0.1)], True, 2)])
def test_champion(spark, others, better, champion):
    rows = [(v, a, r, 0.0, q) for v, a, r, q in [*others, (9, "challenger", 6.0, 0.5)]]
    got = fb.compare_models(spark.createDataFrame(rows, fb.METRICS_SCHEMA)).first()
    assert (got.challenger_is_better, got.champion_version) == (better, champion)


def test_promote(spark):
    rows = [(1, "champion", 1.0, 1.0, 0.1), (2, "challenger", 1.0, 1.0, 0.2)]
    got = fb.promote(spark.createDataFrame(rows, fb.METRICS_SCHEMA), 2)
    assert {r.version: r.alias for r in got.collect()} == {1: None, 2: "champion"}
    assert fb.latest_version(got).first().version == 2


def test_adjusted_targets_equal_the_long_form(pipeline):
    from offerrank.operators import feedback, scoring
    from offerrank.plans.retraining import adjusted_targets
    given = feedback.decided(pipeline.tables["feedback"])
    long = feedback.adjust_targets(scoring.rule_scores(pipeline.features, pipeline.catalog), given).select("member_id", "offer_id", "adjusted_score")
    wide = adjusted_targets(pipeline, given)
    again = wide.unpivot("member_id", [f"score_{o}" for o in pipeline.catalog.offer_ids], "o", "adjusted_score").selectExpr(
        "member_id", "replace(o, 'score_', '') AS offer_id", "adjusted_score")
    assert again.exceptAll(long).isEmpty() and again.count() == long.count()
