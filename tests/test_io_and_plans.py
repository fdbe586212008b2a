import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from offerrank.operators import explain, features, ranking, reports
from offerrank.plans import queries
from offerrank.plans.workspace import Pipeline
from offerrank.sources import tables
from offerrank.sources.fixtures import REFERENCE_TS
from offerrank.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_raw_tables_roundtrip(spark, pipeline, tmp_path):
    tables.save_raw_tables({n: pipeline.tables[n] for n in ("members", "benefits")}, str(tmp_path))
    again = tables.read_table(spark, "benefits", str(tmp_path))
    assert again.drop("created_at").exceptAll(pipeline.tables["benefits"]).isEmpty()
    odd = pipeline.tables["benefits"].withColumn("used_amount", F.lit(float("nan")))
    tables.save_raw_tables({"benefits": odd}, str(tmp_path / "nan"))
    assert tables.read_table(spark, "benefits", str(tmp_path / "nan")).where("used_amount IS NOT NULL").isEmpty()


def test_whole_pipeline_from_saved_tables(spark, pipeline, tmp_path):
    names = ("members", "claims", "benefits", "engagement")
    tables.save_raw_tables({n: pipeline.tables[n] for n in names}, str(tmp_path))
    again = Pipeline(tables.read_raw_tables(spark, str(tmp_path)), REFERENCE_TS)
    assert again.recommendations().exceptAll(pipeline.recommendations()).isEmpty()
    assert again.features.count() == pipeline.features.count()


def test_summary_of_no_recommendations(pipeline):
    row = reports.recommendation_summary(pipeline.recommendations().where("false")).first()
    assert (row.total_recommendations, row.unique_members, row.avg_per_member) == (0, 0, None)


def test_catalog_tables(spark, pipeline):
    tables.create_schema_if_missing(spark, "shop")
    assert not tables.table_exists(spark, "shop.recs")
    tables.save_table(pipeline.recommendations(), "shop.recs", bucket_by=("member_id", 4))
    tables.save_table(pipeline.recommendations().select("member_id"), "shop.recs")  # replaces the schema
    assert spark.table("shop.recs").columns == ["member_id"] and tables.table_exists(spark, "shop.recs")
    tables.create_feedback_table(spark, "shop.feedback")
    tables.create_feedback_table(spark, "shop.feedback")
    assert spark.table("shop.feedback").count() == 0
    assert tables.table_path("a", "b", "c") == "a.b.c"
    spark.sql("DROP SCHEMA shop CASCADE")


def test_feedback_append_keeps_text_as_data(spark, tmp_path):
    rows = [(1, "m", "o", "comment", "it's 'fine'; DROP TABLE x", datetime(2001, 1, 1)),
            (2, "m", "o", "approved", None, datetime(2001, 1, 1))]
    batch = spark.createDataFrame(rows, tables.SCHEMAS["feedback"])
    for _ in range(2):
        tables.append_feedback(batch, str(tmp_path / "f"))
    texts = sorted(r.feedback_text for r in spark.read.parquet(str(tmp_path / "f")).collect())
    assert texts == ["", "", "it's 'fine'; DROP TABLE x", "it's 'fine'; DROP TABLE x"]
    tables.append_feedback_event(spark, str(tmp_path / "f"), 3, "m", "o", "rejected", datetime(2002, 2, 2))
    last = spark.read.parquet(str(tmp_path / "f")).where("feedback_id = 3").first()
    assert (last.feedback, last.feedback_text, last.feedback_time) == ("rejected", "", datetime(2002, 2, 2))


def test_exports(spark, pipeline, tmp_path):
    recs = pipeline.recommendations()
    reports.export_json(recs, str(tmp_path / "j"), REFERENCE_TS)
    meta = spark.read.json(str(tmp_path / "j/metadata")).first()
    assert meta.total_records == recs.count() == spark.read.json(str(tmp_path / "j/recommendations")).count()
    tables.save_csv(recs, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == recs.columns
    tables.save_json(explain.nested_export(pipeline.explanations()), str(tmp_path / "n"))
    assert json.loads(spark.read.text(str(tmp_path / "n")).first()[0])["recommendations"][0]["rank"] == 1
    tables.save_features(pipeline.features.withColumn("segment", F.lit("x")), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).columns == pipeline.features.columns


def test_lookup_pushes_the_member_into_the_scan(spark, pipeline, tmp_path):
    tables.save_serving(pipeline.consolidated(), str(tmp_path / "s"), rows_per_file=100)
    found = reports.member_recommendations(spark.read.parquet(str(tmp_path / "s")), "MBR_00000042")
    assert found.count() == 5
    assert "EqualTo(member_id,MBR_00000042)" in plan(found)
    assert reports.search_members(spark.read.parquet(str(tmp_path / "s")), "0_1", 3).count() == 3


def test_lookup_table_deals_members_out_before_they_are_explained(spark, pipeline, monkeypatch):
    """Range bounds are then taken from the ids alone, and a member's offers and factors are made once."""
    written = []
    monkeypatch.setattr("offerrank.plans.workspace.write_serving", lambda df, path: written.append(df) or df.write.parquet(path))
    serving = Pipeline.serving.func(pipeline)
    lines = plan(written[0]).splitlines()
    at = [next(i for i, line in enumerate(lines) if word in line) for word in ("Generate", "rangepartitioning", "Scan parquet")]
    assert at == sorted(at)
    assert "REPARTITION_BY_NUM" in plan(written[0])  # few bytes do not end in one task
    assert serving.exceptAll(pipeline.consolidated()).isEmpty() and serving.count() == pipeline.consolidated().count()


def test_each_child_table_is_read_once(pipeline):
    """Claims twice: the second time only for the few diagnoses that are not declared."""
    for name, build, times in (("claims", features.claim_features, 2), ("benefits", features.benefit_features, 1),
                               ("engagement", features.engagement_features, 1)):
        raw = pipeline.tables[name]
        before = plan(raw).count("Scan parquet")
        assert plan(build(raw, REFERENCE_TS)).count("Scan parquet") == times * before


def test_sql_work_stays_in_the_jvm_without_cross_products(spark, sf):
    python = {"feedback_adjusted_scores", "gbt_train_metrics", "gbt_recommendations", "feature_importance",
              "tree_explanations", "challenger_metrics", "stream_feedback_counts", "stream_recommendations", "model_consolidated", "feature_group_importance",
              "model_export", "model_factor_display"}
    for name, build in queries.queries().items():
        if name not in python:
            text = plan(build(spark, sf))
            assert "Python" not in text and "MapInArrow" not in text and "MapInPandas" not in text, name
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_ranking_and_explaining_do_not_shuffle(pipeline):
    assert "Exchange hashpartitioning" not in plan(pipeline.recommendations())
    assert "Exchange hashpartitioning" not in plan(pipeline.consolidated())
    build = {name: query for name, query in queries._simple().items()}
    for name in ("campaign_top3", "recs_category_cap", "member_export", "member_text", "summary_prompt", "export_flat"):
        assert "Exchange" not in plan(build[name](pipeline)), name


def test_rows_and_arrays_agree(pipeline):
    """The forms for one row per member and for any recommendations give the same."""
    recs, members = pipeline.recommendations(), pipeline.member_recommendations()
    for rows, arrays in ((ranking.campaign_offers(recs), ranking.campaign_in_rows(members)),
                         (ranking.cap_per_category(recs, 1), ranking.cap_in_rows(members, 1).select("member_id", F.inline("recs"))),
                         (explain.nested_export(pipeline.explanations()), explain.nested_in_rows(pipeline.explained_members()))):
        text = [df.select(F.to_json(F.struct(*sorted(df.columns)))) for df in (rows, arrays)]
        assert text[0].exceptAll(text[1]).isEmpty() and text[0].count() == text[1].count()


def test_explaining_foreign_recommendations(pipeline):
    """The joining form gives the same factors as the carried form."""
    joined = explain.explain_rules(pipeline.features, pipeline.recommendations(), pipeline.catalog)
    columns = ["member_id", "rank", "top_features"]
    assert joined.select(columns).exceptAll(pipeline.explanations().select(columns)).isEmpty()


def test_streamed_counts_ignore_repeats_over_several_batches(spark, pipeline, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    events = pipeline.tables["feedback"]
    stream = spark.readStream.schema(events.schema).parquet(source)
    for part in ("feedback_id % 2 = 0", "true"):  # the second batch repeats the first
        events.where(part).write.mode("append").parquet(source)
        got = jobs.run_feedback_counts(stream, out, state, delay="3650 days")
    assert sorted(got.collect()) == sorted(jobs.feedback_counts(events).collect())


def test_streamed_recommendations_equal_batch(spark, pipeline, tmp_path):
    pipeline.tables["members"].select("member_id").repartition(3).write.parquet(str(tmp_path / "ids"))
    requests = spark.readStream.schema("member_id STRING").parquet(str(tmp_path / "ids"))
    got = jobs.run_recommendations(requests, pipeline.features, str(tmp_path / "out"), str(tmp_path / "state"))
    assert got.exceptAll(pipeline.recommendations()).isEmpty()
    assert got.count() == pipeline.recommendations().count()


def test_streamed_requests_of_a_second_run_are_answered(spark, pipeline, tmp_path):
    ids, out, state = (str(tmp_path / n) for n in ("ids", "out", "state"))
    members = pipeline.tables["members"].select("member_id")
    (tmp_path / "ids").mkdir()
    stream = spark.readStream.schema("member_id STRING").parquet(ids)
    for wanted in ("endswith(member_id, '1')", "endswith(member_id, '2')"):
        members.where(wanted).write.mode("append").parquet(ids)
        got = jobs.run_recommendations(stream, pipeline.features, out, state)
    asked = members.where("right(member_id, 1) IN ('1', '2')")
    assert got.select("member_id").distinct().exceptAll(asked).isEmpty() and got.count() == 5 * asked.count()
    with pytest.raises(ValueError, match="another checkpoint"):
        jobs.run_recommendations(stream, pipeline.features, out, str(tmp_path / "other"))


def test_streamed_counts_drop_late_rows_and_forget_ids(spark, tmp_path):
    ids, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = tables.SCHEMAS["feedback"]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(ids)

    def arrive(*rows):
        spark.createDataFrame([(i, "m", "o", "approved", "", t) for i, t in rows], schema).coalesce(1).write.mode("append").parquet(ids)
        return {r.window_start: r.total_feedback for r in jobs.run_feedback_counts(stream, out, state, window="1 day", delay="2 days").collect()}

    d = [datetime(2001, 1, k) for k in range(1, 30)]
    assert arrive((1, d[0]), (2, d[0])) == {d[0]: 2}
    assert arrive((1, d[0]), (3, d[1])) == {d[0]: 2, d[1]: 1}  # a repeat across a restart
    assert arrive((4, d[20])) == {d[0]: 2, d[1]: 1, d[20]: 1}
    assert arrive((5, d[2])) == {d[0]: 2, d[1]: 1, d[20]: 1}  # too late
    assert arrive((6, d[19])) == {d[0]: 2, d[1]: 1, d[19]: 1, d[20]: 1}  # late, but in time
    with pytest.raises(ValueError, match="another checkpoint"):
        jobs.run_feedback_counts(stream, out, str(tmp_path / "other"))


def test_factors_with_unknown_names_are_shown(pipeline):
    explained = pipeline.explanations()
    short = explain.display_factors(explained, ["age"], explain.profile_columns())
    full = explain.display_factors(explained, explain.rule_inputs(pipeline.catalog, features.FEATURES), explain.profile_columns())
    assert short.exceptAll(full).isEmpty() and short.count() == full.count()


def test_summary_and_report_of_one_tally(spark, pipeline):
    """Both forms agree, and the report reads the features once."""
    recs, members = pipeline.recommendations(), pipeline.tables["members"]
    shown = lambda df: sorted((r.section, r.label, r.value) for r in df.collect())
    assert shown(reports.report_of_tally(pipeline.tally)) == shown(reports.recommendation_report(recs, members))
    assert not [r for r in shown(reports.recommendation_report(recs)) if r[0] == "age_groups"]
    counted = plan(reports.tally_in_rows(pipeline.member_recommendations(), members))
    assert counted.count("FileScan parquet") - plan(members).count("FileScan parquet") == 1


def test_summary_of_odd_recommendations(spark):
    rows = [("m1", "a", "A", "x", 10.0), ("m1", "a", "A", "x", 10.0), ("m1", "b", "B", "x", 30.0),
            (None, "b", "B", "x", 20.0), ("m2", None, None, None, None)]
    recs = spark.createDataFrame(rows, "member_id STRING, offer_id STRING, offer_name STRING, category STRING, priority_score DOUBLE")
    recs = recs.withColumn("age_group", F.lit("clash"))
    row = reports.recommendation_summary(recs).first()
    assert (row.total_recommendations, row.unique_members, row.unique_offers) == (5, 2, 2)
    assert (row.mean_score, row.median_score, row.min_score, row.max_score) == (17.5, 15.0, 10.0, 30.0)
    assert abs(row.std_score - 9.574271077563381) < 1e-12 and row.avg_per_member == 2.5
    members = spark.createDataFrame([("m1", 30), ("m1", 40), (None, 70), ("m2", None)], "member_id STRING, age INT")
    ages = {r.label: r.value for r in reports.recommendation_report(recs, members).where("section = 'age_groups'").collect()}
    assert ages == {"<35": 0.0, "35-50": 3.0, "50-65": 0.0, "65+": 0.0}


def test_tables_by_member_are_aggregated_and_joined_in_place(spark, pipeline):
    tables.create_schema_if_missing(spark, "by_member")
    names = ["members", "claims", "benefits", "engagement"]
    assert tables.save_by_member({n: pipeline.tables[n] for n in names}, "by_member", 4) == names
    raw = tables.read_raw_tables(spark, "by_member")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        engaged = features.engagement_features(raw["engagement"], REFERENCE_TS)
        assert "Exchange" not in plan(features.join_features(raw["members"], raw["claims"], raw["benefits"], engaged, REFERENCE_TS))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    again = Pipeline(raw, REFERENCE_TS)
    assert again.recommendations().exceptAll(pipeline.recommendations()).isEmpty()
    spark.sql("DROP SCHEMA by_member CASCADE")


def test_a_table_with_a_crowded_member_is_not_put_in_buckets(spark):
    tables.create_schema_if_missing(spark, "crowd")
    ids = spark.range(9000).selectExpr("CASE WHEN id < 5000 THEN NULL ELSE CAST(id AS STRING) END AS member_id", "id AS n")
    given = {"hot": ids, "even": ids.where("n >= 5000"), "none": ids.where("false")}
    assert tables.save_by_member(given, "crowd", 16) == ["even", "none"]
    for name, df in given.items():
        assert spark.table(f"crowd.{name}").exceptAll(df).isEmpty() and spark.table(f"crowd.{name}").count() == df.count()
    assert "SelectedBucketsCount" in plan(spark.table("crowd.even").groupBy("member_id").count())
    spark.sql("DROP SCHEMA crowd CASCADE")


def test_predictions_of_all_members_are_not_broadcast(pipeline):
    """The size that is guessed for them is far too small: 42 MB were broadcast of 15,000 members."""
    model = pipeline.train(2)
    bases = queries.tree_bases(pipeline, model)
    assert "SortMergeJoin [member_id" in plan(bases) and "BroadcastHashJoin [member_id" not in plan(bases)
    rows = bases.collect()
    assert len(rows) == pipeline.model_pairs(model).count() and len({(r.offer_id, round(r.base, 6)) for r in rows}) == len({r.offer_id for r in rows})
