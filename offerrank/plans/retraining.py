"""The feedback loop: adjust targets, retrain a challenger, compare, promote."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerrank import fixed_values as fv
from offerrank.operators import feedback, learn, scoring
from offerrank.operators.features import FEATURES
from offerrank.operators.learn import OfferModel
from offerrank.plans.workspace import Pipeline
from offerrank.session import materialize


@dataclass
class Challenger:
    model: OfferModel
    metrics: DataFrame  # one row: rmse, mae, r2, avg_rmse_per_offer on held-out members


def adjusted_targets(p: Pipeline, given: DataFrame) -> DataFrame:
    """Features with a feedback-adjusted ``score_<offer>`` column per offer, written once.

    A member's adjustments are one map, at most as long as the catalog, so the
    wide scores are joined once and never taken apart.
    """
    by_offer = feedback.feedback_adjustments(given).groupBy("member_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "offer_id", F.struct("shift", "low", "high").alias("a")))).alias("_by_offer"))
    wide = scoring.training_data(p.features, p.catalog).join(by_offer, "member_id", "left")
    adjusted = {}
    for o in p.catalog.offer_ids:
        a, score = F.try_element_at("_by_offer", F.lit(o)), F.col(f"score_{o}")
        adjusted[f"score_{o}"] = F.coalesce(F.least(a["high"], F.greatest(a["low"], score + a["shift"])), score)
    return materialize(wide.withColumns(adjusted).drop("_by_offer"), "adjusted-targets")


def train_challenger(p: Pipeline, given: DataFrame, rounds: int = fv.TREE_SETTINGS["rounds"], depth: int | None = None,
                     use_weights: bool = False) -> Challenger:
    """Members are split first and only training rows are repeated, so that no
    copy of a training row is tested on."""
    targets = adjusted_targets(p, given)
    train, test = learn.split_train_test(targets)
    weighted = feedback.oversample_feedback(train, given)
    model = OfferModel.fit(weighted, p.catalog.offer_ids, FEATURES, rounds, depth,
                           "sample_weight" if use_weights else None)
    return Challenger(model, materialize(learn.regression_metrics(learn.prediction_pairs(model, test)), "challenger-metrics"))


def retrain(p: Pipeline, all_feedback: DataFrame, versions: DataFrame, **settings) -> tuple[Challenger, DataFrame] | None:
    """Train and compare when there is enough feedback; None when there is not.

    ``versions`` is the model-version table; the second result is that table
    with the challenger added, as champion if it is better.
    """
    given = feedback.decided(all_feedback)
    if not feedback.retrain_gate(given).first()["retrain"]:
        return None
    challenger = train_challenger(p, given, **settings)
    latest = feedback.latest_version(versions).first()["version"] or 0
    entry = challenger.metrics.select(F.lit(latest + 1).alias("version"), F.lit("challenger").alias("alias"),
                                      "rmse", "mae", "r2")
    known = versions.withColumn("alias", F.when(F.col("alias") != "challenger", F.col("alias")))
    table = known.unionByName(entry)
    if feedback.compare_models(table).first()["challenger_is_better"]:
        table = feedback.promote(table, latest + 1)
    return challenger, table
