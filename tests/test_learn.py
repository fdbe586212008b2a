import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from offerrank.operators import learn, ranking, scoring
from offerrank.operators.treeshap import add_from_tables, explain_trees, feature_vector, leaf_table, pattern_tables, shapley_values

NODES = pd.DataFrame(  # two trees; feature 0 is split twice on one path
    [(0, 1.0, 0, 0.0, 100.0, 1, 2, 0, 5.0), (0, 1.0, 1, 1.0, 60.0, -1, -1, -1, None),
     (0, 1.0, 2, 0.0, 40.0, 3, 4, 1, 0.5), (0, 1.0, 3, 4.0, 10.0, 5, 6, 0, 8.0), (0, 1.0, 4, 7.0, 30.0, -1, -1, -1, None),
     (0, 1.0, 5, -3.0, 4.0, -1, -1, -1, None), (0, 1.0, 6, 9.0, 6.0, -1, -1, -1, None),
     (1, 0.1, 0, 0.0, 100.0, 1, 2, 2, 1.5), (1, 0.1, 1, 20.0, 50.0, -1, -1, -1, None), (1, 0.1, 2, 30.0, 50.0, -1, -1, -1, None)],
    columns=["tree", "weight", "id", "value", "rows", "left", "right", "feature", "threshold"])


def expectation(x, known):
    """Tree output with only the ``known`` features given."""
    total = 0.0
    for _, tree in NODES.groupby("tree"):
        nodes = {r.id: r for r in tree.itertuples()}

        def walk(at):
            n = nodes[at]
            if n.feature < 0:
                return n.value
            if n.feature in known:
                return walk(n.left if x[n.feature] <= n.threshold else n.right)
            return sum(nodes[c].rows / n.rows * walk(c) for c in (n.left, n.right))
        total += tree["weight"].iloc[0] * walk(0)
    return total


def test_tree_shapley_equals_brute_force():
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.uniform(0, 10, 20), rng.uniform(0, 1, 20), rng.uniform(0, 3, 20), rng.uniform(0, 1, 20)])
    phi = shapley_values(leaf_table(NODES), x)
    for row, got in zip(x, phi):
        for i in range(4):
            rest = [j for j in range(4) if j != i]
            want = sum(
                math.factorial(len(s)) * math.factorial(3 - len(s)) / 24
                * (expectation(row, {*s, i}) - expectation(row, set(s)))
                for n in range(4) for s in itertools.combinations(rest, n))
            assert got[i] == pytest.approx(want, abs=1e-9)
        assert got.sum() == pytest.approx(expectation(row, {0, 1, 2, 3}) - expectation(row, set()), abs=1e-9)


def test_leaves_by_table_equal_leaves_by_met_patterns():
    rng = np.random.default_rng(1)
    x = np.where(rng.uniform(size=(50, 4)) < 0.1, np.nan, rng.integers(0, 20, (50, 4)) / 2)
    leaves = leaf_table(NODES)
    phi = np.zeros(x.shape)
    add_from_tables(leaves, pattern_tables(leaves), x, phi)
    assert phi == pytest.approx(shapley_values(leaves, x, {}), abs=1e-12)
    assert shapley_values(leaves, x) == pytest.approx(phi, abs=1e-12)


@pytest.fixture(scope="module")
def trained(pipeline):
    names = ["age", "risk_score", "has_diabetes", "total_claims_count", "high_risk_flag"]
    data = scoring.training_data(pipeline.features, pipeline.catalog)
    offers = ["PREV_001", "CHRON_001"]
    return learn.OfferModel.fit(data, offers, names, rounds=2, depth=2), data


def test_model_roundtrip_and_contract(trained, spark, tmp_path):
    model, data = trained
    model.save(str(tmp_path / "m"))
    again = learn.OfferModel.load(str(tmp_path / "m"))
    a, b = (m.predict(data).orderBy("member_id").collect() for m in (model, again))
    assert a == b and again.feature_names == model.feature_names
    assert all(0 <= s.score <= 100 for r in a for s in r.scores)
    importance = model.feature_importance(spark).collect()
    assert len(importance) == 5 and sum(r.importance for r in importance) > 0


def test_tree_explanations_add_up(trained, spark, pipeline):
    model, data = trained
    raw = model.transform(data).select("member_id", *[F.col(f"pred_{o}") for o in model.offer_ids])
    pairs = ranking.recommend(model.predict(data.withColumn("x", feature_vector(model)), ["member_id", "x"]),
                              pipeline.catalog, 2, None, keep=["member_id", "x"])
    total = F.aggregate("top_features", F.lit(0.0), lambda a, f: a + f["shap_value"])
    rows = explain_trees(model, pairs, k=5).withColumn("total", total).join(raw, "member_id").collect()
    for offer in model.offer_ids:  # prediction minus contributions is the same base for all members
        bases = [r[f"pred_{offer}"] - r.total for r in rows if r.offer_id == offer]
        assert len(bases) and max(bases) - min(bases) < 0.01


def test_metrics(spark):
    rows = [("a", "x", 1.0, 2.0), ("b", "x", 3.0, 3.0), ("a", "y", 5.0, 5.0), ("b", "y", 5.0, 6.0)]
    m = learn.regression_metrics(spark.createDataFrame(rows, "member_id STRING, offer_id STRING, y DOUBLE, p DOUBLE")).first()
    assert m.rmse == pytest.approx(math.sqrt(2 / 4)) and m.mae == 0.5
    assert m.r2 == pytest.approx((0.5 + 0.0) / 2)
    assert m.avg_rmse_per_offer == pytest.approx(math.sqrt(0.5))


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 7), (3.0, 7)], "a DOUBLE, b INT")
    rows = scoring.StandardScaler.fit(df, ["a", "b"]).transform(df).collect()
    assert [tuple(r) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]


def test_rule_contributions_add_up(pipeline):
    """Contributions of an offer = score - mean score where nothing is clipped."""
    total = F.aggregate("top_features", F.lit(0.0), lambda a, f: a + f["shap_value"])
    rows = pipeline.explanations().withColumn("total", total)
    means = scoring.rule_scores(pipeline.features).groupBy("offer_id").agg(
        F.avg("score").alias("mean"), F.max("score").alias("top"))
    gaps = rows.join(means.where("top < 100"), "offer_id").withColumn(
        "gap", F.abs(F.col("priority_score") - F.col("mean") - F.col("total")))
    assert gaps.where("gap > 0.01").isEmpty() and not gaps.isEmpty()
