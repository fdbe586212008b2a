"""Summaries of recommendations and exports for other platforms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerrank import fixed_values as fv
from offerrank.functions.scalar import bin_label, one_row, round_even
from offerrank.session import materialize


def offer_distribution(recs: DataFrame) -> DataFrame:
    return recs.groupBy("offer_name").agg(
        F.count("member_id").alias("recommendations"), F.avg("priority_score").alias("avg_score")
    ).orderBy(F.desc("recommendations"), "offer_name")


def category_scores(recs: DataFrame) -> DataFrame:
    return recs.groupBy("category").agg(F.avg("priority_score").alias("avg_score")).orderBy("avg_score")


def category_counts(recs: DataFrame) -> DataFrame:
    return recs.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def category_share(recs: DataFrame) -> DataFrame:
    counts = category_counts(recs)
    total = recs.agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") / one_row(total)["n"] * 100)


def top_offer_counts(recs: DataFrame, k: int = 5) -> DataFrame:
    return (recs.groupBy("offer_name").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "offer_name").limit(k))


def recs_by_age_group(recs: DataFrame, members: DataFrame) -> DataFrame:
    """Recommendations per age bin; empty bins count 0, unknown ages are left out."""
    ages = recs.select("member_id").join(members.select("member_id", "age"), "member_id", "left")
    counts = (ages.select(bin_label(F.col("age"), fv.REPORT_AGE_BINS, fv.REPORT_AGE_LABELS).alias("age_group"))
              .groupBy("age_group").agg(F.count(F.lit(1)).alias("n")))
    bins = recs.sparkSession.createDataFrame([(b,) for b in fv.REPORT_AGE_LABELS], "age_group STRING")
    return bins.join(counts, "age_group", "left").fillna(0, ["n"])


#: What a summary tells recommendations apart by; scores have two digits, so a tally is bounded by groups, offers and scores.
TALLY = ["age_group", "offer_id", "offer_name", "category", "priority_score"]


def _age_groups(members: DataFrame) -> DataFrame:
    """The report's age bin of each member; of repeated members the highest age counts."""
    oldest = members.where(F.col("member_id").isNotNull()).groupBy("member_id").agg(F.max("age").alias("age"))
    return oldest.select("member_id", bin_label(F.col("age"), fv.REPORT_AGE_BINS, fv.REPORT_AGE_LABELS).alias("age_group"))


def tally_in_rows(recs: DataFrame, members: DataFrame) -> DataFrame:
    """Recommendations ``n`` and members counted, by age group, offer, category and score.

    ``recs`` has one row per member with an array ``recs``; a member is counted
    at its first offer, so that the sum of ``members`` is the number of members.
    """
    rows = (recs.select("member_id", "recs").join(_age_groups(members), "member_id", "left")
            .select("member_id", "age_group", F.posexplode("recs").alias("_place", "_rec")))
    first = (F.col("_place") == 0) & F.col("member_id").isNotNull()
    return rows.groupBy("age_group", *[F.col("_rec")[c].alias(c) for c in TALLY[1:]]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(first).alias("members"))


def tally(recs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """:func:`tally_in_rows` of any recommendations, one in a row; repeated rows count each, members once.

    A member is counted at its least offer. Both counts combine before they are
    shuffled, whatever share of the rows a member has.
    """
    rows = recs.select("member_id", *TALLY[1:])
    ages = _age_groups(members) if members is not None else None
    rows = rows.join(ages, "member_id", "left") if ages is not None else rows.withColumn("age_group", F.lit(None).cast("string"))
    counts = rows.groupBy(*TALLY).agg(F.count(F.lit(1)).alias("n")).withColumn("members", F.lit(0).cast("bigint"))
    firsts = (rows.where(F.col("member_id").isNotNull()).groupBy("member_id").agg(F.min(F.struct(*TALLY)).alias("_least"))
              .groupBy("_least").agg(F.count(F.lit(1)).alias("members"))
              .select("_least.*", F.lit(0).cast("bigint").alias("n"), "members"))
    return counts.unionByName(firsts).groupBy(*TALLY).agg(F.sum("n").alias("n"), F.sum("members").alias("members"))


def summary_of_tally(counted: DataFrame) -> DataFrame:
    """Totals and score statistics in one row, all exact; rows without a score count, but not in its statistics."""
    n, score = F.col("n"), F.col("priority_score")
    scored = F.sum(F.when(score.isNotNull(), n))
    centre = one_row(counted.agg(F.try_divide(F.sum(n * score), scored).alias("mean")))["mean"]
    squares = F.sum(n * (score - F.col("_centre")) * (score - F.col("_centre")))
    return counted.withColumn("_centre", centre).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_recommendations"),
        F.try_divide(F.sum(n * score), scored).alias("mean_score"),
        F.sqrt(F.try_divide(squares, scored - 1)).alias("std_score"),
        F.min(score).alias("min_score"), F.max(score).alias("max_score"),
        F.coalesce(F.sum("members"), F.lit(0)).alias("unique_members"),
        F.count_distinct("offer_id").alias("unique_offers"),
        F.percentile(score, 0.5, n).alias("median_score"),
    ).withColumn("avg_per_member", F.try_divide(F.col("total_recommendations").cast("double"), "unique_members"))


def recommendation_summary(recs: DataFrame) -> DataFrame:
    """:func:`summary_of_tally` of any recommendations; the tally is written once."""
    return summary_of_tally(materialize(tally(recs), "tally"))


def report_of_tally(counted: DataFrame, with_ages: bool = True) -> DataFrame:
    """The summary as long rows of (section, label, value)."""
    rounded = lambda c: round_even(F.col(c).cast("double"), 4)
    measures = ["total_recommendations", "unique_members", "unique_offers", "avg_per_member",
                "mean_score", "std_score", "min_score", "max_score", "median_score"]
    report = summary_of_tally(counted).select(F.inline(F.array(*[
        F.struct(F.lit("overview").alias("section"), F.lit(m).alias("label"), rounded(m).alias("value"))
        for m in measures])))
    totals = lambda by: counted.groupBy(by).agg(F.sum("n").alias("n"))
    parts = [("top_offers", "offer_name", totals("offer_name").orderBy(F.desc("n"), "offer_name").limit(5)),
             ("categories", "category", totals("category"))]
    if with_ages:
        bins = counted.sparkSession.createDataFrame([(b,) for b in fv.REPORT_AGE_LABELS], "age_group STRING")
        parts.append(("age_groups", "age_group", bins.join(totals("age_group"), "age_group", "left").fillna(0, ["n"])))
    for section, label, df in parts:
        report = report.unionByName(df.select(F.lit(section).alias("section"), F.col(label).alias("label"),
                                              F.col("n").cast("double").alias("value")))
    return report


def recommendation_report(recs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """:func:`report_of_tally` of any recommendations; age groups only when members are given."""
    return report_of_tally(materialize(tally(recs, members), "tally"), members is not None)


def json_rows(recs: DataFrame) -> DataFrame:
    """One JSON document per recommendation."""
    return recs.select(F.to_json(F.struct(*recs.columns)).alias("value"))


def export_json(recs: DataFrame, path: str, generated_at: datetime, include_metadata: bool = True) -> None:
    """Write the recommendations as JSON lines plus a one-row metadata file."""
    recs.write.mode("overwrite").json(f"{path}/recommendations")
    if include_metadata:
        members = recs.groupBy("member_id").agg(F.count(F.lit(1)).alias("n"))
        meta = members.agg(F.lit(generated_at.isoformat()).alias("generated_at"),
                           F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
                           F.count("member_id").alias("unique_members"))
        meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def for_marketing(recs: DataFrame, created: datetime, platform: str = "generic") -> DataFrame:
    """Add the campaign fields and use the column names of the platform."""
    return recs.withColumns({
        "created_date": F.lit(created.strftime("%Y-%m-%d")), "campaign_type": F.lit(fv.CAMPAIGN_TYPE),
    }).withColumnsRenamed(fv.PLATFORM_COLUMNS.get(platform, {}))


def campaign_export(recs: DataFrame, created: datetime) -> DataFrame:
    return recs.withColumns({"recommendation_date": F.lit(created.strftime("%Y-%m-%d")),
                             "campaign_id": F.lit(fv.CAMPAIGN_ID)})


def member_profile(member_id: str, features: DataFrame, recs: DataFrame) -> DataFrame:
    """Profile struct and ranked offers of one member, or one row with ``error``."""
    chosen = features.where(F.col("member_id") == member_id).select(
        "member_id", F.struct(
            F.col("age").cast("int").alias("age"), F.col("risk_score").cast("double").alias("risk_score"),
            F.col("chronic_condition_count").cast("int").alias("chronic_conditions"),
            F.col("total_claims_count").cast("int").alias("total_claims"),
            F.col("total_engagements").cast("int").alias("total_engagements")).alias("features"))
    rec = F.struct(*[c for c in recs.columns if c != "member_id"])
    offers = (recs.where(F.col("member_id") == member_id).groupBy("member_id")
              .agg(F.sort_array(F.collect_list(rec)).alias("recommendations")))
    asked = recs.sparkSession.createDataFrame([(member_id,)], "member_id STRING")
    found = F.col("features").isNotNull()
    return (asked.join(chosen, "member_id", "left").join(offers, "member_id", "left")
            .withColumn("error", F.when(~found, F.concat(F.lit("Member "), F.col("member_id"), F.lit(" not found")))))


def search_members(published: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """Ids that contain the term; ``%`` and ``_`` in it are wildcards."""
    return (published.where(F.col("member_id").like(f"%{term}%")).select("member_id").distinct()
            .orderBy("member_id").limit(limit))


def list_members(published: DataFrame, limit: int = 500) -> DataFrame:
    return published.select("member_id").distinct().orderBy("member_id").limit(limit)


SERVING_COLUMNS = [
    "member_id", "offer_id", "offer_name", "rank", "priority_score", "llm_reasoning", "shap_factors", "age",
    "risk_score", "chronic_condition_count", "has_diabetes", "has_cardiovascular", "has_respiratory",
    "has_mental_health", "is_complex_patient", "tenure_months", "total_claims", "total_engagements",
    "avg_utilization_rate", "high_risk_flag"]


def member_recommendations(published: DataFrame, member_id: str, limit: int = 5) -> DataFrame:
    return (published.where(F.col("member_id") == member_id).select(*SERVING_COLUMNS)
            .orderBy("rank").limit(limit))


def sample_members(df: DataFrame, n: int, seed: str = "") -> DataFrame:
    """Exactly ``n`` members (or all), the same ones however the data is split."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col("member_id"))), "member_id").limit(n)
