"""Whole jobs: publication and the feedback loop."""

from datetime import datetime

from offerrank.operators.feedback import METRICS_SCHEMA
from offerrank.plans.retraining import retrain
from offerrank.plans.workspace import Pipeline
from offerrank.session import size_shuffles


def test_publish(spark, pipeline, tmp_path):
    pipeline.publish(str(tmp_path))
    members = pipeline.features.count()
    assert spark.read.parquet(str(tmp_path / "consolidated")).count() == 5 * members
    assert spark.read.parquet(str(tmp_path / "recommendations")).count() == 5 * members
    assert spark.read.parquet(str(tmp_path / "campaign")).count() == members
    assert spark.read.json(str(tmp_path / "members")).count() == members


def test_publish_a_model(spark, pipeline, tmp_path):
    model = pipeline.train(rounds=2, depth=2)
    pipeline.publish(str(tmp_path), model, "7")
    published = spark.read.parquet(str(tmp_path / "consolidated"))
    wanted = pipeline.explanations(model=model).select("member_id", "rank", "offer_id", "priority_score")
    assert {r.model_version for r in published.select("model_version").distinct().collect()} == {"7"}
    assert published.select("member_id", "rank", "offer_id", "priority_score").exceptAll(wanted).isEmpty() and published.count() == wanted.count()
    ages = published.select("member_id", "age").distinct().join(pipeline.features.selectExpr("member_id", "age AS real"), "member_id")
    assert ages.where("age <> real").isEmpty()
    shown = spark.read.json(str(tmp_path / "members"))
    assert shown.count() == wanted.select("member_id").distinct().count()


def test_feedback_loop(spark, pipeline):
    versions = spark.createDataFrame([(3, "champion", 99.0, 99.0, 0.0)], METRICS_SCHEMA)
    feedback = pipeline.tables["feedback"]
    assert retrain(pipeline, feedback.limit(3), versions) is None
    challenger, table = retrain(pipeline, feedback, versions, rounds=1, depth=2, use_weights=True)
    assert {r.version: r.alias for r in table.collect()} == {3: None, 4: "champion"}
    assert challenger.metrics.first().rmse > 0


def test_encoders_are_reused(spark, pipeline):
    """A later run gives categories the codes of the first run."""
    one_region = pipeline.tables["members"].where("region = 'EUROPE'")
    later = Pipeline({**pipeline.tables, "members": one_region}, datetime(2001, 11, 6))
    later.builder.encoders = pipeline.builder.encoders
    codes = {r.region_encoded for r in later.features.select("region_encoded").distinct().collect()}
    known = pipeline.builder.encoders.codes.where("column = 'region'").orderBy("value").collect()
    assert codes == {[r.value for r in known].index("EUROPE")}


def test_shuffle_size(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        size_shuffles(spark, 100 << 40)
        assert spark.conf.get(key) == str((100 << 40) // (128 << 20))
        size_shuffles(spark, 10 << 30)
        assert spark.conf.get(key) == "80"
    finally:
        spark.conf.unset(key)
