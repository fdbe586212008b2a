"""Rule scores, score normalisation and training data."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerrank.catalog import Catalog
from offerrank.functions.scalar import clip_score, one_row
from offerrank.operators.quantiles import average_ranks
from offerrank.operators.rule_tables import RULES_AS_EXPRESSIONS, RuleTables


def hash_noise(offer_id: str | Column, sd: float, seed: int) -> Column:
    """Normal noise from a hash of member, offer and seed (Box-Muller).

    Unlike ``randn`` it does not depend on partitioning or row order.
    """
    def uniform(salt: int) -> Column:
        digest = F.xxhash64(F.col("member_id"), F.lit(offer_id) if isinstance(offer_id, str) else offer_id, F.lit(seed), F.lit(salt))
        return (F.pmod(digest, F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    return F.lit(sd) * F.sqrt(-2 * F.ln(uniform(1))) * F.cos(F.lit(2 * math.pi) * uniform(2))


def rule_score_columns(columns: list[str], catalog: Catalog, noise_sd: float = 0.0,
                       seed: int = 42) -> dict[str, Column]:
    """One clipped score expression per offer."""
    resolved = catalog.resolved_rules(columns)
    scores = {}
    for offer in catalog.offers:
        terms = [f"{float(offer.base_score)}D"] + [
            rule.boost_sql(feature) for rule, feature in resolved if rule.offer_id == offer.offer_id]
        total = F.expr(" + ".join(terms))
        if noise_sd:
            total = total + hash_noise(offer.offer_id, noise_sd, seed)
        scores[offer.offer_id] = clip_score(total)
    return scores


def score_array(scores: dict[str, Column]) -> Column:
    """One struct (score, turn, offer_id, ord) per offer.

    Falling struct order is ranking order: higher score first, then the offer
    that comes first in the catalog, because ``turn`` is minus ``ord``.
    """
    return F.array(*[
        F.struct(score.cast("double").alias("score"), F.lit(-place).alias("turn"),
                 F.lit(offer_id).alias("offer_id"), F.lit(place).alias("ord"))
        for place, (offer_id, score) in enumerate(scores.items())])


def with_rule_scores(features: DataFrame, catalog: Catalog, noise_sd: float = 0.0, seed: int = 42) -> DataFrame:
    """Features plus the ``scores`` array the ranking functions read.

    A catalog of up to ``RULES_AS_EXPRESSIONS`` rules and offers is compiled with
    the query; a larger one is looked up in sorted tables, with the same scores.
    """
    if len(catalog.rules) + len(catalog.offers) <= RULES_AS_EXPRESSIONS:
        return features.withColumn("scores", score_array(rule_score_columns(features.columns, catalog, noise_sd, seed)))
    ids = F.from_json(F.lit(json.dumps(catalog.offer_ids)), "array<string>")

    def scored(total: Column, place: Column) -> Column:
        offer = F.element_at(ids, place + 1)
        score = clip_score(total + hash_noise(offer, noise_sd, seed) if noise_sd else total)
        return F.struct(score.cast("double").alias("score"), (-place).alias("turn"), offer.alias("offer_id"), place.alias("ord"))

    return RuleTables(catalog, features.columns).with_totals(features, "_totals").withColumn(
        "scores", F.transform("_totals", scored)).drop("_totals")


def rule_scores(features: DataFrame, catalog: Catalog | None = None, noise_sd: float = 0.0,
                seed: int = 42) -> DataFrame:
    """Target scores: rows of (member_id, offer_id, ord, score)."""
    scored = with_rule_scores(features, catalog or Catalog(), noise_sd, seed)
    return scored.select("member_id", F.inline("scores")).select(
        "member_id", "offer_id", "ord", "score")


def rule_scores_wide(features: DataFrame, catalog: Catalog | None = None, noise_sd: float = 0.0,
                     seed: int = 42) -> DataFrame:
    """Target scores as one column ``score_<offer>`` per offer."""
    scores = rule_score_columns(features.columns, catalog or Catalog(), noise_sd, seed)
    return features.select("member_id", *[s.alias(f"score_{o}") for o, s in scores.items()])


def rule_boosts(features: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """What every rule adds: rows of (member_id, offer_id, rule, feature, value, boost)."""
    entries = [
        F.struct(F.lit(rule.offer_id).alias("offer_id"), F.lit(rule.name).alias("rule"),
                 F.lit(feature).alias("feature"), F.col(feature).cast("double").alias("value"),
                 rule.boost_column(feature).cast("double").alias("boost"))
        for rule, feature in (catalog or Catalog()).resolved_rules(features.columns)]
    return features.select("member_id", F.inline(F.array(*entries)))


def training_data(features: DataFrame, catalog: Catalog | None = None, noise_sd: float = 0.0,
                  seed: int = 42) -> DataFrame:
    """Features and targets side by side: member_id, features..., score_<offer>..."""
    scores = rule_score_columns(features.columns, catalog or Catalog(), noise_sd, seed)
    return features.select("*", *[s.alias(f"score_{o}") for o, s in scores.items()])


def normalize_scores(df: DataFrame, column: str, method: str = "minmax",
                     output: str = "normalized") -> DataFrame:
    """Map scores to 0..100 by range, z-score or average-rank percentile."""
    score = F.col(column)
    if method == "percentile":
        ranks = average_ranks(df, column)
        return df.join(ranks, column, "left").withColumn(
            output, F.col("average_rank") / F.col("total") * 100).drop("average_rank", "total")
    if method == "minmax":
        stats = df.agg(F.min(score).alias("low"), F.max(score).alias("high"))
        spread = F.col("_stats.high") - F.col("_stats.low")
        scaled = (score - F.col("_stats.low")) / spread * 100
    elif method == "zscore":
        stats = df.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"))
        spread = F.col("_stats.sd")
        scaled = clip_score(((score - F.col("_stats.mean")) / spread + 3) / 6 * 100)
    else:
        raise ValueError(f"unknown normalisation method: {method}")
    value = F.when(score.isNotNull(), F.when(spread == 0, F.lit(50.0)).otherwise(scaled))
    return df.withColumn("_stats", one_row(stats)).withColumn(output, value).drop("_stats")


class StandardScaler:
    """Scale columns to mean 0 and population deviation 1.

    A constant column gets deviation 1, so that scaling maps it to 0. Fitting
    brings two numbers per column to the driver, as any fitted model does.
    """

    def __init__(self, moments: dict[str, tuple[float, float]]):
        self.moments = moments

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> "StandardScaler":
        numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        rows = (numbers.unpivot([], columns, "column", "value").groupBy("column")
                .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).collect())
        return cls({row["column"]: (row["mean"], row["sd"] or 1.0) for row in rows})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(mean)) / F.lit(sd)
                               for c, (mean, sd) in self.moments.items()})
