"""Member segments and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerrank import fixed_values as fv
from offerrank.functions.scalar import one_row, round_even
from offerrank.operators.quantiles import quantile_row


def member_segments(features: DataFrame) -> DataFrame:
    """Features plus ``segment``; a stronger segment overrides a weaker one."""
    limits = quantile_row(features, {"claims": ("total_claims_count", fv.UTILIZER_QUANTILE),
                                     "engagements": ("total_engagements", fv.ENGAGER_QUANTILE)})
    seniors, new, utilizers, engagers, chronic, standard = fv.SEGMENTS
    segment = (
        F.when(F.col("is_senior") == 1, seniors)
        .when(F.col("is_new_member") == 1, new)
        .when(F.col("total_claims_count") > F.col("_limits.claims"), utilizers)
        .when((F.col("total_engagements") > F.col("_limits.engagements"))
              & (F.col("avg_response_rate") > fv.ENGAGER_RESPONSE), engagers)
        .when((F.col("chronic_condition_count") >= fv.CHRONIC_CONDITIONS)
              & (F.col("risk_score") > fv.CHRONIC_RISK), chronic)
        .otherwise(standard))
    return features.withColumn("_limits", one_row(limits)).withColumn("segment", segment).drop("_limits")


def segment_summary(segmented: DataFrame) -> DataFrame:
    """Size, share and means of each segment.

    Rounding to nine digits first keeps the summation order out of the ties.
    """
    means = {"avg_age": "age", "avg_claims": "total_claims_count", "avg_claim_amount": "total_claims_amount",
             "avg_utilization": "avg_utilization_rate", "avg_engagements": "total_engagements",
             "avg_risk_score": "risk_score"}
    folded = segmented.groupBy("segment").agg(
        F.count("member_id").alias("members"), F.count(F.lit(1)).alias("_rows"),
        *[round_even(F.round(F.avg(c), 9), 2).alias(name) for name, c in means.items()])
    total = segmented.agg(F.count(F.lit(1)).alias("n"))
    return folded.withColumn("pct", round_even(F.col("members") / one_row(total)["n"] * 100, 1)).drop("_rows") \
        .orderBy(F.desc("members"), "segment")
