import pytest
from pyspark.sql import functions as F

from offerrank.catalog import Catalog, Offer, Rule
from offerrank.operators import ranking, scoring


@pytest.fixture(scope="module")
def small():
    offers = [Offer(f"O{i}", f"Offer {i}", "odd" if i % 2 else "even", 50.0) for i in range(6)]
    rules = [Rule("O1", "x_boost", "min", 10.0, 7.0), Rule("O2", "x_boost", "max", 10.0, 100.0),
             Rule("O3", "diabetes_boost", "scale", None, 4.0), Rule("O4", "missing_boost", "min", 0.0, 9.0)]
    return Catalog(offers, rules)


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame([("a", 10.0, 1), ("b", 11.0, None), ("c", None, 2)],
                                 "member_id STRING, x DOUBLE, has_diabetes INT")


def test_rules(features, small):
    scores = {(r.member_id, r.offer_id): r.score for r in scoring.rule_scores(features, small).collect()}
    assert [scores["a", f"O{i}"] for i in range(6)] == [50, 57, 100, 54, 50, 50]  # both bounds included, clipped
    assert scores["b", "O3"] == 50 and scores["c", "O1"] == 50 and scores["c", "O3"] == 58
    assert small.unresolved_rules(features.columns) == ["missing_boost"]
    assert Catalog().unresolved_rules(["age"]).count("pharmacy_utilization_boost") == 1


def test_wide_and_long_scores_agree(features, small):
    wide = {r["member_id"]: r for r in scoring.rule_scores_wide(features, small).collect()}
    for r in scoring.rule_scores(features, small).collect():
        assert wide[r.member_id][f"score_{r.offer_id}"] == r.score


def test_ties_follow_the_catalog(features, small):
    top = ranking.top_offers(ranking.with_rule_scores(features, small), 4)
    got = [r.offer_id for r in top.where("member_id = 'b'").orderBy("rank").collect()]
    assert got == ["O1", "O0", "O2", "O3"]


def test_array_and_window_ranking_agree(pipeline):
    scored = ranking.with_rule_scores(pipeline.features, pipeline.catalog)
    a = ranking.top_offers(scored, 5)
    b = ranking.top_offers_long(scoring.rule_scores(pipeline.features, pipeline.catalog), 5)
    columns = ["member_id", "rank", "offer_id", "priority_score"]
    assert a.select(columns).exceptAll(b.select(columns)).isEmpty()
    assert a.count() == b.count()


def test_exclusion_looks_at_twice_n_only(features, small):
    recs = ranking.recommend(ranking.with_rule_scores(features, small), small, 2, None, ["even"])
    got = [(r.rank, r.offer_id) for r in recs.where("member_id = 'b'").orderBy("rank").collect()]
    assert got == [(1, "O1"), (2, "O3")]  # first four: O1 O0 O2 O3


def test_minimum_score_uses_the_rounded_score(spark, small):
    scored = spark.createDataFrame([("a",)], "member_id STRING").withColumn(
        "scores", scoring.score_array({"O0": F.lit(29.996), "O1": F.lit(29.99)}))
    assert [r.offer_id for r in ranking.recommend(scored, small, 5, 30.0).collect()] == ["O0"]


def test_properties(pipeline):
    recs = pipeline.recommendations(5, 60.0)
    bad = recs.groupBy("member_id").agg(F.max("rank").alias("m"), F.count("*").alias("n"), F.min("rank").alias("l"))
    assert bad.where("m <> n OR l <> 1").isEmpty()
    assert recs.where("priority_score < 60 OR priority_score > 100").isEmpty()
    capped = ranking.cap_per_category(recs, 1)
    assert capped.groupBy("member_id", "category").count().where("count > 1").isEmpty()


def test_noise_does_not_depend_on_partitions(features, small):
    one = scoring.rule_scores(features.repartition(1), small, noise_sd=5.0)
    many = scoring.rule_scores(features.repartition(5), small, noise_sd=5.0)
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()
    assert not one.exceptAll(scoring.rule_scores(features, small)).isEmpty()


def test_normalise_constant_and_unknown(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "s DOUBLE")
    for method in ("minmax", "zscore"):
        assert [r.normalized for r in scoring.normalize_scores(df, "s", method).collect()] == [50.0, 50.0]
    with pytest.raises(ValueError):
        scoring.normalize_scores(df, "s", "other")


def test_catalog_from_tables(spark):
    same = Catalog.from_frames(Catalog().offers_frame(spark), Catalog().rules_frame(spark))
    assert same.offers == Catalog().offers and len(same.rules) == len(Catalog().rules)


def test_large_catalogs_are_read_whole(spark):
    offers = spark.range(1001).selectExpr("format_string('O%04d', id) AS offer_id", "'n' AS offer_name", "'c' AS category", "1.0D AS base_score",
                                          "'' AS description", "1.0D AS priority_weight", "array() AS target_conditions", "CAST(1000 - id AS INT) AS ord")
    rules = spark.range(100_001).selectExpr("'O0001' AS offer_id", "concat('r', id) AS rule", "'min' AS kind", "0.0D AS threshold", "1.0D AS boost")
    catalog = Catalog.from_frames(offers, rules)
    assert len(catalog.offers) == 1001 and catalog.offer_ids[0] == "O1000" and len(catalog.rules) == 100_001
    assert [r.name for r in catalog.rules] == sorted(r.name for r in catalog.rules)
