"""Why an offer was recommended: rule contributions, factor text, exports."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerrank.catalog import Catalog
from offerrank.functions.scalar import fitted, round_even
from offerrank.functions.text import factor_family, factor_sentence, factor_title
from offerrank.operators.rule_tables import RULES_AS_EXPRESSIONS, RuleTables

FACTOR_SCHEMA = "ARRAY<STRUCT<feature: STRING, value: DOUBLE, shap_value: DOUBLE, direction: STRING>>"
TERM_SCHEMA = "ARRAY<STRUCT<feature: STRING, value: DOUBLE, shap_value: DOUBLE>>"
PROFILE = ["age", "risk_score", "chronic_condition_count", "total_claims_count", "total_engagements",
           "is_senior", "has_diabetes", "has_cardiovascular", "has_respiratory", "has_mental_health",
           "is_complex_patient", "tenure_months", "high_risk_flag", "avg_utilization_rate",
           "avg_response_rate"]


def strongest(factors: Column, k: int) -> Column:
    """First ``k`` factors by absolute contribution, then feature name."""
    keyed = F.transform(factors, lambda f: F.struct(
        (-F.abs(f["shap_value"])).alias("key"), f["feature"].alias("feature"), f["value"].alias("value"),
        f["shap_value"].alias("shap_value")))
    return F.transform(F.slice(F.sort_array(keyed), 1, k), lambda f: F.struct(
        f["feature"].alias("feature"), round_even(f["value"], 2).alias("value"),
        (round_even(f["shap_value"], 3) + 0.0).alias("shap_value"),
        F.when(f["shap_value"] > 0, "increases").otherwise("decreases").alias("direction")))


def rule_inputs(catalog: Catalog, columns: list[str]) -> list[str]:
    """Feature columns the rules read, each once, in catalog order."""
    return list(dict.fromkeys(feature for _, feature in catalog.resolved_rules(columns)))


def with_rule_factors(pairs: DataFrame, features: DataFrame, catalog: Catalog, k: int = 5) -> DataFrame:
    """Add ``top_features`` to recommendations that carry the rule inputs.

    A rule score is a sum of terms, so the Shapley value of a term is the term
    minus its mean over the members in ``features``.
    """
    if len(catalog.rules) + len(catalog.offers) > RULES_AS_EXPRESSIONS:
        tables = RuleTables(catalog, features.columns)
        return tables.with_factors(pairs, tables.means(features), k)
    return pairs.withColumn("top_features", rule_factors(features, catalog, k)(F.col("offer_id")))


def rule_factors(features: DataFrame, catalog: Catalog, k: int = 5) -> Callable[[Column], Column]:
    """From an offer id to its strongest factors in a row that has the rule inputs."""
    resolved = catalog.resolved_rules(features.columns)
    means = fitted(features.agg(*[F.avg(rule.boost_column(feature)).alias(str(i))
                                  for i, (rule, feature) in enumerate(resolved)]))
    by_offer = {}
    for offer_id in reversed(catalog.offer_ids):
        terms = [f"named_struct('feature', '{feature}', 'value', CAST(`{feature}` AS DOUBLE), 'shap_value', "
                 f"{rule.boost_sql(feature)} - CAST({means[str(i)] or 0.0!r} AS DOUBLE))"
                 for i, (rule, feature) in enumerate(resolved) if rule.offer_id == offer_id]
        if terms:
            by_offer[offer_id] = F.expr(f"array({', '.join(terms)})")

    def of(offer: Column) -> Column:
        factors = F.array().cast(TERM_SCHEMA)
        for offer_id, terms in by_offer.items():
            factors = F.when(offer == offer_id, terms).otherwise(factors)
        return strongest(factors, k)

    return of


def explain_rules(features: DataFrame, recs: DataFrame, catalog: Catalog, k: int = 5,
                  profile: list[str] = ()) -> DataFrame:
    """Any recommendations with their strongest rule contributions.

    Only the columns the rules and the profile need are joined in.
    """
    inputs = rule_inputs(catalog, features.columns)
    needed = features.select("member_id", *dict.fromkeys([*profile, *inputs]))
    explained = with_rule_factors(recs.join(needed, "member_id"), features, catalog, k)
    return explained.select(*recs.columns, *profile, "top_features")


def display_factors(explained: DataFrame, names: list[str], profile: dict[str, Column]) -> DataFrame:
    """One row per factor with the reader-facing name and sentence.

    ``names`` are features to expect. What depends on the name alone is computed
    once for each, in a table as long as that list; for a name that is not in it
    the same is computed row by row.
    """
    feature = F.col("feature")
    known = explained.sparkSession.createDataFrame([(n,) for n in names], "feature STRING").select(
        "feature", factor_title(feature).alias("title"), factor_family(feature).alias("_family"))
    rows = explained.select("*", F.posexplode("top_features").alias("_place", "_factor")).select(
        "*", F.col("_factor.feature").alias("feature"))
    supports = F.col("_factor.direction") == "increases"
    title, family = F.coalesce("title", factor_title(feature)), F.coalesce("_family", factor_family(feature))
    return rows.join(F.broadcast(known), "feature", "left").select(
        "member_id", "rank", "offer_id", (F.col("_place") + 1).alias("factor_rank"), "feature", title.alias("title"),
        factor_sentence(family, F.col("_factor.value"), supports, profile).alias("sentence"))


def profile_columns() -> dict[str, Column]:
    """Profile values a factor sentence may quote, by profile key."""
    return {"age": F.col("age"), "risk_score": F.col("risk_score"),
            "chronic_condition_count": F.col("chronic_condition_count"),
            "has_diabetes": F.col("has_diabetes"), "has_cardiovascular": F.col("has_cardiovascular"),
            "total_claims": F.col("total_claims_count")}


def nested_in_rows(members: DataFrame) -> DataFrame:
    """:func:`nested_export` of rows that hold a member's profile and its ``recs`` with factors."""
    recs = F.transform("recs", lambda r: F.struct(
        r["rank"].alias("rank"), r["offer_id"].alias("offer_id"), r["offer_name"].alias("offer_name"),
        r["priority_score"].alias("priority_score"), r["top_features"].alias("key_factors")))
    return members.select("member_id", _profile(lambda c, t: F.col(c).cast(t)).alias("profile"), recs.alias("recommendations"))


def _profile(value: Callable[[str, str], Column]) -> Column:
    return F.struct(
        value("age", "int").alias("age"), value("risk_score", "double").alias("risk_score"),
        value("chronic_condition_count", "int").alias("chronic_condition_count"),
        value("total_claims_count", "int").alias("total_claims"),
        value("total_engagements", "int").alias("total_engagements"),
        *[value(c, "boolean").alias(c) for c in (
            "is_senior", "has_diabetes", "has_cardiovascular", "has_respiratory",
            "has_mental_health", "is_complex_patient")])


def nested_export(explained: DataFrame) -> DataFrame:
    """One row per member: profile struct and recommendations with their factors."""
    rec = F.struct("rank", "offer_id", "offer_name", "priority_score",
                   F.col("top_features").alias("key_factors"))
    profile = _profile(lambda c, t: F.first(F.col(c).cast(t)))
    return explained.groupBy("member_id").agg(
        profile.alias("profile"), F.sort_array(F.collect_list(rec)).alias("recommendations"))


def flatten_export(nested: DataFrame) -> DataFrame:
    """Flat rows again: member, four profile values, one recommendation."""
    rows = nested.select("member_id", "profile", F.explode("recommendations").alias("rec"))
    return rows.select(
        "member_id", F.col("profile.age").alias("age"), F.col("profile.risk_score").alias("risk_score"),
        F.col("profile.chronic_condition_count").alias("chronic_conditions"),
        *[F.col(f"rec.{c}").alias(c) for c in ("rank", "offer_id", "offer_name", "priority_score")])


def consolidate(explained: DataFrame, generated_at: datetime, model_version: str = "demo") -> DataFrame:
    """The flat 24-column publication table; factors as JSON text."""
    bools = ("has_diabetes", "has_cardiovascular", "has_respiratory", "has_mental_health",
             "is_complex_patient")
    return explained.select(
        "member_id", "offer_id", "offer_name", "rank", "priority_score",
        F.lit("").alias("llm_reasoning"), F.to_json("top_features").alias("shap_factors"),
        F.col("age").cast("int").alias("age"), F.col("risk_score").cast("double").alias("risk_score"),
        F.col("chronic_condition_count").cast("int").alias("chronic_condition_count"),
        F.col("total_claims_count").cast("int").alias("total_claims"),
        F.col("total_engagements").cast("int").alias("total_engagements"),
        *[F.col(c).cast("boolean").alias(c) for c in bools],
        F.col("tenure_months").cast("int").alias("tenure_months"),
        F.col("is_senior").cast("int").alias("is_senior"),
        F.col("high_risk_flag").cast("int").alias("high_risk_flag"),
        F.col("avg_utilization_rate").cast("double").alias("avg_utilization_rate"),
        F.col("avg_response_rate").cast("double").alias("avg_response_rate"),
        F.lit(generated_at.isoformat()).alias("generated_at"),
        F.lit(model_version).alias("model_version"))


def parse_factors(text: Column, k: int = 5) -> Column:
    """First ``k`` factors of a JSON text; an empty array when it is not valid."""
    return F.slice(F.coalesce(F.from_json(text, FACTOR_SCHEMA), F.array().cast(FACTOR_SCHEMA)), 1, k)
