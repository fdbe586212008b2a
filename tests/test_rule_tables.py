"""Catalogs looked up in tables: the same as compiled ones, and usable at a thousand offers and a hundred thousand rules."""

import random
import time

import pytest
from pyspark.sql import functions as F

from offerrank.catalog import Catalog, Offer, Rule
from offerrank.operators import explain, ranking, rule_tables, scoring


@pytest.fixture(scope="module")
def features(spark):
    rng = random.Random(4)
    rows = [(f"m{k}", rng.choice([None, 1.0, 5.0, rng.uniform(0, 100)]), rng.choice([None, 0, 1]), rng.randrange(50)) for k in range(60)]
    return spark.createDataFrame(rows, "member_id string, x double, has_flag int, y int")


def catalog(offers, rules, seed=1):
    rng = random.Random(seed)
    made = [Rule(f"O{rng.randrange(offers):04d}", rng.choice(["x_boost", "flag_boost", "y_boost", "nothing_boost"]), kind := rng.choice(["min", "max", "scale"]),
                 None if kind == "scale" else float(rng.randrange(100)), rng.choice([-2.0, 0.5, 1.25])) for _ in range(rules)]
    return Catalog([Offer(f"O{k:04d}", f"Offer {k}", f"c{k % 7}", float(k % 50), f"d{k}") for k in range(offers)], made)


def plain(rows, columns):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in rows), key=str)


def test_equal_to_compiled_rules(features, monkeypatch):
    small = catalog(9, 120)
    compiled = scoring.rule_scores(features, small).collect(), scoring.rule_scores(features, small, noise_sd=2.0).collect()
    columns = ["member_id", "rank", "offer_id", "priority_score"]
    inputs = ["member_id", *explain.rule_inputs(small, features.columns)]

    def explained():
        recs = ranking.recommend(scoring.with_rule_scores(features, small), small, 4, None, keep=inputs)
        return explain.with_rule_factors(recs, features, small, 200).collect()
    first = explained()
    monkeypatch.setattr(scoring, "RULES_AS_EXPRESSIONS", 0)
    monkeypatch.setattr(explain, "RULES_AS_EXPRESSIONS", 0)
    for want, noise in zip(compiled, (0.0, 2.0)):
        got = scoring.rule_scores(features, small, noise_sd=noise).collect()
        assert plain(got, ["member_id", "offer_id", "ord", "score"]) == plain(want, ["member_id", "offer_id", "ord", "score"])
    again = explained()
    assert plain(again, columns) == plain(first, columns)
    sums = [{(r.member_id, r.offer_id): sorted((f.feature, f.value, round(f.shap_value, 2)) for f in r.top_features) for r in rows} for rows in (first, again)]
    assert sums[0] == sums[1]


def test_a_large_catalog(spark, features):
    """Scored, ranked and explained; checked by adding up the rules of each offer."""
    large = catalog(1001, 100_001)
    t = time.time()
    inputs = ["member_id", *explain.rule_inputs(large, features.columns)]
    recs = ranking.recommend(scoring.with_rule_scores(features, large), large, 5, None, keep=inputs)
    rows = explain.with_rule_factors(recs, features, large).collect()
    assert len(rows) == 5 * 60 and all(len(r.top_features) == 5 for r in rows)
    assert time.time() - t < 60
    by_offer = {}
    for rule, feature in large.resolved_rules(features.columns):
        by_offer.setdefault(rule.offer_id, []).append((rule, feature))
    people, base = {r.member_id: r for r in features.collect()}, {o.offer_id: o.base_score for o in large.offers}

    def boost(rule, v):
        if rule.kind == "scale":
            return (v or 0) * rule.boost
        return rule.boost if v is not None and (v >= rule.threshold if rule.kind == "min" else v <= rule.threshold) else 0.0
    for r in rows[::7]:
        terms = [(rule, f, boost(rule, people[r.member_id][f])) for rule, f in by_offer[r.offer_id]]
        score = min(100, max(0, base[r.offer_id] + sum(b for _, _, b in terms)))
        assert r.priority_score == pytest.approx(score, abs=0.006)
        gaps = sorted((abs(b - sum(boost(rule, p[f]) for p in people.values()) / len(people)) for rule, f, b in terms), reverse=True)[:5]
        assert [abs(f.shap_value) for f in r.top_features] == pytest.approx(gaps, abs=0.0011)
    members = ranking.recommend_in_rows(scoring.with_rule_scores(features, large), large, 3, None)
    assert members.select(F.explode("recs").alias("r")).where("r.offer_name is null or r.category is null").isEmpty()


def test_no_rules_and_no_members(spark, features):
    none = Catalog([Offer(f"O{k}", "n", "c", 5.0) for k in range(rule_tables.RULES_AS_EXPRESSIONS + 1)], [])
    assert {r.score for r in scoring.rule_scores(features, none).collect()} == {5.0}
    assert scoring.rule_scores(features.limit(0), catalog(500, 600)).collect() == []
