"""The 96 member features.

Each child table is read once and folded with one grouped aggregate, whose
partial form absorbs a member that owns a large share of the rows. The small
per-member results are then joined to the members on the same key.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerrank import fixed_values as fv
from offerrank.functions.scalar import bin_label, elapsed_days, fitted, flag, within_days
from offerrank.operators.encode import LabelEncoder
from offerrank.operators.quantiles import quantile_row
from offerrank.session import materialize

LABEL_COLUMNS = ["gender", "region", "plan_type", "income_bracket", "age_group", "tenure_group"]

DEMOGRAPHIC = (["age", "tenure_months", "family_size", "risk_score", "chronic_condition_count"]
               + [f"{c}_encoded" for c in LABEL_COLUMNS]
               + ["is_senior", "is_new_member", "has_chronic_condition", "high_risk_flag"])
CLAIMS = (["total_claims_count", "total_claims_amount", "avg_claim_amount", "std_claim_amount",
           "max_claim_amount", "total_paid_amount", "avg_paid_amount", "total_member_cost",
           "avg_member_cost", "in_network_rate"]
          + [f"claims_last_{d}d" for d in fv.CLAIM_WINDOWS]
          + [f"{t}_visit_count" for t in fv.CLAIM_TYPES]
          + ["days_since_last_claim", "claim_frequency_trend", "cost_per_claim"])
DIAGNOSIS = ([f"has_{d}" for d in fv.FLAGGED_DIAGNOSES]
             + ["unique_diagnosis_count", "is_complex_patient"])
BENEFITS = ([f"{t}_utilization_rate" for t in fv.BENEFIT_TYPES]
            + ["total_benefits_used", "total_remaining_balance", "total_annual_max",
               "avg_utilization_rate", "max_utilization_rate", "std_utilization_rate",
               "total_benefit_claims", "remaining_deductible_pct", "days_since_last_benefit_use"])
ENGAGEMENT = (["total_engagements", "avg_response_rate", "avg_session_duration"]
              + [f"engagements_last_{d}d" for d in fv.ENGAGEMENT_WINDOWS]
              + [f"{c}_engagement_rate" for c in fv.CHANNELS]
              + [f"{t}_count" for t in fv.ENGAGEMENT_TYPES]
              + ["preferred_channel_encoded", "days_since_last_engagement", "engagement_trend"])
TEMPORAL = ["current_month", "current_quarter", "is_q4", "is_open_enrollment", "is_flu_season",
            "is_allergy_season", "days_until_year_end", "benefits_urgency"]
FEATURES = DEMOGRAPHIC + CLAIMS + DIAGNOSIS + BENEFITS + ENGAGEMENT + TEMPORAL


def _recent_count(ref: datetime, date: str, row_id: str, days: int) -> Column:
    """Rows in the last ``days`` days, null (not 0) when there is none."""
    return F.sum(F.when(within_days(ref, F.col(date), days), F.col(row_id).isNotNull().cast("int")))


def _count_of(column: str, value: str, row_id: str) -> Column:
    return F.count(F.when(F.col(column) == value, F.col(row_id)))


def _mean_of_flag(column: str) -> Column:
    return F.avg(F.col(column).cast("int"))


def exact_sum(column: str) -> Column:
    """A sum of doubles that does not depend on the order of rows.

    Multiples of 2^-16 add up without error (to 10^11), and what is left over is
    too small for its order to show. Sums of amounts often end in half a cent,
    where the last bit decides how a text shows them.
    """
    value = F.col(column).cast("double")
    coarse = F.rint(value * 65536.0) / 65536.0
    return F.sum(coarse) + F.sum(F.nanvl(value - coarse, F.lit(0.0)))  # infinite values leave nothing over


def _mean(total: str, column: str) -> Column:
    return F.try_divide(F.col(total), F.col(f"_n_{column}"))


def demographic_labels(members: DataFrame) -> DataFrame:
    """Member attributes with bin labels and flags, labels not yet encoded."""
    return members.select(
        "member_id", "age", "tenure_months", "family_size", "risk_score",
        "chronic_condition_count", "gender", "region", "plan_type", "income_bracket",
        bin_label(F.col("age"), fv.AGE_BINS, fv.AGE_LABELS).alias("age_group"),
        bin_label(F.col("tenure_months"), fv.TENURE_BINS, fv.TENURE_LABELS).alias("tenure_group"),
        flag(F.col("age") >= fv.SENIOR_AGE).alias("is_senior"),
        flag(F.col("tenure_months") <= fv.NEW_MEMBER_MONTHS).alias("is_new_member"),
        flag(F.col("chronic_condition_count") > 0).alias("has_chronic_condition"),
        flag(F.col("risk_score") > fv.HIGH_RISK_SCORE).alias("high_risk_flag"))


def claim_sums(claims: DataFrame, ref: datetime) -> DataFrame:
    """Claims and diagnosis features of one aggregate, but for the diagnoses outside the declared list.

    Of these only the least and the greatest hash of each member's are kept: who
    has no two of them needs no other pass over the claims.
    """
    diagnosis = F.col("diagnosis_category")
    seen = {d: F.max(flag((diagnosis == d) & F.col("claim_id").isNotNull())).alias(f"_dx_{d}")
            for d in fv.DIAGNOSES}
    unlisted = F.when(~diagnosis.isin(fv.DIAGNOSES) & F.col("claim_id").isNotNull(), diagnosis)
    mark = F.when(unlisted.isNotNull(), F.xxhash64(unlisted))
    folded = claims.groupBy("member_id").agg(
        F.count("claim_id").alias("total_claims_count"),
        exact_sum("claim_amount").alias("total_claims_amount"),
        F.count("claim_amount").alias("_n_claim_amount"),
        F.stddev_samp("claim_amount").alias("std_claim_amount"),
        F.max("claim_amount").alias("max_claim_amount"),
        exact_sum("paid_amount").alias("total_paid_amount"),
        F.count("paid_amount").alias("_n_paid_amount"),
        exact_sum("member_responsibility").alias("total_member_cost"),
        F.count("member_responsibility").alias("_n_member_responsibility"),
        _mean_of_flag("in_network").alias("in_network_rate"),
        *[_recent_count(ref, "claim_date", "claim_id", d).alias(f"claims_last_{d}d")
          for d in fv.CLAIM_WINDOWS],
        *[_count_of("claim_type", t, "claim_id").alias(f"{t}_visit_count") for t in fv.CLAIM_TYPES],
        F.max("claim_date").alias("_last_claim"),
        F.min(mark).alias("_dx_low"), F.max(mark).alias("_dx_high"),
        *seen.values())
    return folded.withColumns({
        "avg_claim_amount": _mean("total_claims_amount", "claim_amount"),
        "avg_paid_amount": _mean("total_paid_amount", "paid_amount"),
        "avg_member_cost": _mean("total_member_cost", "member_responsibility"),
        "days_since_last_claim": elapsed_days(ref, F.col("_last_claim")),
        "claim_frequency_trend": F.coalesce("claims_last_180d", F.lit(0))
        / (F.coalesce("claims_last_365d", F.lit(1)) + 1),
        "cost_per_claim": F.col("total_claims_amount") / (F.col("total_claims_count") + 1),
        **{f"has_{d}": F.col(f"_dx_{d}") for d in fv.FLAGGED_DIAGNOSES},
        "_dx_listed": sum(F.col(f"_dx_{d}") for d in fv.DIAGNOSES),
    }).select("member_id", *CLAIMS, *[c for c in DIAGNOSIS if c.startswith("has_")], "_dx_listed", "_dx_low", "_dx_high")


def _count_diagnoses(df: DataFrame, unlisted: Column) -> DataFrame:
    """``df`` with the two features that need the number of diagnoses outside the list."""
    counted = df.withColumn("unique_diagnosis_count", (F.col("_dx_listed") + unlisted).cast("bigint"))
    complex_patient = F.when(F.col("_dx_listed").isNotNull(), flag(F.col("unique_diagnosis_count") >= fv.COMPLEX_DIAGNOSES))
    return counted.withColumn("is_complex_patient", complex_patient).drop("_dx_listed", "_dx_low", "_dx_high")


def with_diagnosis_counts(df: DataFrame, claims: DataFrame) -> DataFrame:
    """:func:`claim_sums` rows with all diagnoses counted; a second, narrow aggregate counts those outside the declared list."""
    diagnosis = F.col("diagnosis_category")
    unlisted = F.when(~diagnosis.isin(fv.DIAGNOSES) & F.col("claim_id").isNotNull(), diagnosis)
    rare = (claims.select("member_id", unlisted.alias("_dx")).where(F.col("_dx").isNotNull()).distinct()
            .groupBy("member_id").agg(F.count(F.lit(1)).alias("_dx_unlisted")))
    return _count_diagnoses(df.join(rare, "member_id", "left"), F.coalesce("_dx_unlisted", F.lit(0))).drop("_dx_unlisted")


def claim_features(claims: DataFrame, ref: datetime) -> DataFrame:
    """Claims and diagnosis features."""
    return with_diagnosis_counts(claim_sums(claims, ref), claims).select("member_id", *CLAIMS, *DIAGNOSIS)


def benefit_features(benefits: DataFrame, ref: datetime) -> DataFrame:
    rate = F.col("utilization_rate")
    folded = benefits.groupBy("member_id").agg(
        *[F.avg(F.when(F.col("benefit_type") == t, rate)).alias(f"{t}_utilization_rate")
          for t in fv.BENEFIT_TYPES],
        exact_sum("used_amount").alias("total_benefits_used"),
        exact_sum("remaining_balance").alias("total_remaining_balance"),
        exact_sum("annual_max").alias("total_annual_max"),
        F.avg(rate).alias("avg_utilization_rate"),
        F.max(rate).alias("max_utilization_rate"),
        F.stddev_samp(rate).alias("std_utilization_rate"),
        F.sum("claims_count").alias("total_benefit_claims"),
        F.max("last_used_date").alias("_last_used"))
    return folded.withColumns({
        "remaining_deductible_pct": F.col("total_remaining_balance") / (F.col("total_annual_max") + 1),
        "days_since_last_benefit_use": elapsed_days(ref, F.col("_last_used")),
    }).select("member_id", *BENEFITS)


def engagement_features(engagement: DataFrame, ref: datetime) -> DataFrame:
    """Engagement features, with ``preferred_channel`` still as text."""
    folded = engagement.groupBy("member_id").agg(
        F.count("engagement_id").alias("total_engagements"),
        _mean_of_flag("response_flag").alias("avg_response_rate"),
        F.avg("session_duration_sec").alias("avg_session_duration"),
        *[_recent_count(ref, "engagement_date", "engagement_id", d).alias(f"engagements_last_{d}d")
          for d in fv.ENGAGEMENT_WINDOWS],
        *[_count_of("channel", c, "engagement_id").alias(f"_n_{c}") for c in fv.CHANNELS],
        F.count(F.when(F.col("channel").isNotNull(), F.col("engagement_id"))).alias("_n_channels"),
        *[_count_of("engagement_type", t, "engagement_id").alias(f"{t}_count")
          for t in fv.ENGAGEMENT_TYPES],
        F.max("engagement_date").alias("_last_engagement"))
    # the largest count wins, then the alphabetically first channel
    candidates = [F.struct(F.col(f"_n_{c}").alias("n"), F.lit(-i).alias("place"), F.lit(c).alias("channel"))
                  for i, c in enumerate(fv.CHANNELS)]
    return folded.withColumns({
        **{f"{c}_engagement_rate": F.col(f"_n_{c}") / (F.col("_n_channels") + 1) for c in fv.CHANNELS},
        "preferred_channel": F.array_max(F.array(*candidates))["channel"],
        "days_since_last_engagement": elapsed_days(ref, F.col("_last_engagement")),
        "engagement_trend": F.coalesce("engagements_last_30d", F.lit(0))
        / (F.coalesce("total_engagements", F.lit(1)) + 1) * 12,
    }).select("member_id", "preferred_channel",
              *[c for c in ENGAGEMENT if c != "preferred_channel_encoded"])


def temporal_features(ref: datetime) -> dict[str, Column]:
    """Calendar constants of the reference time."""
    quarter = (ref.month + 2) // 3
    days_left = (datetime(ref.year, 12, 31) - ref).days
    ints = {
        "current_month": ref.month, "current_quarter": quarter, "is_q4": int(quarter == 4),
        "is_open_enrollment": int(ref.month in fv.OPEN_ENROLLMENT_MONTHS),
        "is_flu_season": int(ref.month in fv.FLU_MONTHS),
        "is_allergy_season": int(ref.month in fv.ALLERGY_MONTHS),
        "days_until_year_end": days_left,
    }
    return {**{name: F.lit(value) for name, value in ints.items()},
            "benefits_urgency": F.lit(1.0 - days_left / 365)}


def _joined(members: DataFrame, groups: list[DataFrame], ref: datetime) -> DataFrame:
    wide = demographic_labels(members)
    for group in groups:
        wide = wide.join(group, "member_id", "left")
    return wide.withColumns(temporal_features(ref))


def join_features(members: DataFrame, claims: DataFrame, benefits: DataFrame,
                  engaged: DataFrame, ref: datetime) -> DataFrame:
    """Members with every feature group; no fills, labels as text.

    ``engaged`` is the result of :func:`engagement_features`.
    """
    return _joined(members, [claim_features(claims, ref), benefit_features(benefits, ref), engaged], ref)


def written_features(members: DataFrame, claims: DataFrame, benefits: DataFrame,
                     engaged: DataFrame, ref: datetime) -> DataFrame:
    """:func:`join_features`, written; the claims are read a second time only if some member has two diagnoses outside the list."""
    columns = join_features(members, claims, benefits, engaged, ref).columns
    wide = materialize(_joined(members, [claim_sums(claims, ref), benefit_features(benefits, ref), engaged], ref), "raw-features")
    if wide.where("_dx_low < _dx_high").isEmpty():
        return _count_diagnoses(wide, F.col("_dx_low").isNotNull().cast("int")).select(columns)
    return materialize(with_diagnosis_counts(wide, claims).select(columns), "raw-features")


def fill_rule(name: str) -> str:
    """How a missing value of the column is filled: zero, median or no_activity."""
    return next(rule for words, rule in fv.FILL_POLICY if any(w in name for w in words))


def fill_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill numeric columns by name; medians are fitted on the same frame."""
    by_median = [c for c in columns if fill_rule(c) == "median"]
    medians = fitted(quantile_row(df, {c: (c, 0.5) for c in by_median})) if by_median else {}
    fills = {"zero": lambda c: 0, "no_activity": lambda c: fv.NO_ACTIVITY_DAYS, "median": medians.get}
    types = {f.name: f.dataType for f in df.schema}
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(fills[fill_rule(c)](c)).cast(types[c])) for c in columns})


class FeatureBuilder:
    """Builds the feature table; keeps the fitted label encoders and, as ``raw``, the features before filling.

    Encoders are fitted on the first table and reused afterwards, so a later
    run (scoring) gives a category the same code as the first (training).
    """

    def __init__(self, reference_ts: datetime, encoders: LabelEncoder | None = None):
        self.reference_ts = reference_ts
        self.encoders = encoders
        self.feature_names = list(FEATURES)

    def build(self, members: DataFrame, claims: DataFrame, benefits: DataFrame,
              engagement: DataFrame) -> DataFrame:
        ref = self.reference_ts
        engaged = materialize(engagement_features(engagement, ref), "engaged")
        raw = self.raw = written_features(members, claims, benefits, engaged, ref)
        if self.encoders is None:
            self.encoders = LabelEncoder.fit(raw, LABEL_COLUMNS).merged_with(
                LabelEncoder.fit(engaged, ["preferred_channel"]))
        # no engagement at all: no channel to encode
        encoded = self.encoders.encode(raw, [*LABEL_COLUMNS, "preferred_channel"], keep_null=["preferred_channel"])
        return fill_missing(encoded, FEATURES).select("member_id", *FEATURES)
