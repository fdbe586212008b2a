"""Descriptive statistics: summaries, shares, histograms, correlation."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerrank import fixed_values as fv
from offerrank.functions.scalar import fitted, one_row
from offerrank.operators.quantiles import exact_quantiles, quantile_row

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of a numeric column, one row."""
    basics = df.agg(F.count(column).alias("count"), F.avg(column).alias("mean"),
                    F.stddev_samp(column).alias("std"), F.min(column).alias("min"),
                    F.max(column).alias("max"))
    quartiles = quantile_row(df, {name: (column, p) for name, p in QUARTILES.items()})
    return basics.withColumn("_q", one_row(quartiles)).select(
        "count", "mean", "std", "min", *[F.col(f"_q.{q}").alias(q) for q in QUARTILES], "max")


def value_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of each value among the non-null values: (column, value, n, share)."""
    counts = (df.select(*[F.col(c).cast("string").alias(c) for c in columns])
                .unpivot([], columns, "column", "value")
                .where(F.col("value").isNotNull())
                .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("column").agg(F.sum("n").alias("_total"))
    return counts.join(totals, "column").select(
        "column", "value", "n", (F.col("n") / F.col("_total")).alias("share"))


def claims_per_member(claims: DataFrame) -> DataFrame:
    """min, mean, median and max of the claims per member that has claims."""
    sizes = claims.groupBy("member_id").agg(F.count(F.lit(1)).alias("n"))
    spread = sizes.agg(F.min("n").alias("min_claims"), F.avg("n").alias("mean_claims"),
                       F.max("n").alias("max_claims"))
    median = quantile_row(sizes, {"median_claims": ("n", 0.5)})
    return spread.withColumn("_q", one_row(median)).select(
        "min_claims", "mean_claims", F.col("_q.median_claims").alias("median_claims"), "max_claims")


def benefit_summary(benefits: DataFrame) -> DataFrame:
    return benefits.groupBy("benefit_type").agg(
        F.avg("utilization_rate").alias("mean_utilization"),
        F.stddev_samp("utilization_rate").alias("std_utilization"),
        F.sum("used_amount").alias("used_amount"),
        F.sum("remaining_balance").alias("remaining_balance"))


def response_rate(engagement: DataFrame) -> DataFrame:
    return engagement.agg(F.avg(F.col("response_flag").cast("int")).alias("response_rate"))


def member_claim_summary(members: DataFrame, claims: DataFrame) -> DataFrame:
    """Members with their claim count and amount, zero without claims."""
    folded = claims.groupBy("member_id").agg(
        F.count("claim_id").alias("claim_count"), F.sum("claim_amount").alias("total_claim_amount"))
    return members.join(folded, "member_id", "left").fillna(
        {"claim_count": 0, "total_claim_amount": 0.0})


def histogram(df: DataFrame, value: Column, bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins from min to max; the last bin includes the maximum.

    Rows of (by..., bin from 0, low, high, n); empty bins are left out. With
    ``by`` every group has its own range.
    """
    by = by or []
    values = df.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    limits = values.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    if by:
        placed = values.join(limits, by)
    else:
        low, high = fitted(limits).values()
        placed = values.withColumns({"_low": F.lit(low).cast("double"), "_high": F.lit(high).cast("double")})
    width = (F.col("_high") - F.col("_low")) / bins
    bin_no = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_low")) / width))).cast("int")
    counted = placed.withColumns({"bin": bin_no, "_width": width}).groupBy(*by, "bin", "_low", "_width").agg(
        F.count(F.lit(1)).alias("n"))
    return counted.select(
        *by, "bin", (F.col("_low") + F.col("bin") * F.col("_width")).alias("low"),
        (F.col("_low") + (F.col("bin") + 1) * F.col("_width")).alias("high"), "n")


def claim_amount_histogram(claims: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(claims, F.least(F.col("claim_amount"), F.lit(fv.HISTOGRAM_CLAIM_CAP)), bins)


def feature_histograms(features: DataFrame, columns: list[str] | None = None, bins: int = 50) -> DataFrame:
    """Histograms of several features: (feature, bin, low, high, n).

    Strongly skewed totals are shown as log(1 + x) of their positive values.
    """
    names = columns or fv.HISTOGRAM_FEATURES
    shown = {c: F.when(F.col(c) > 0, F.log1p(c)) if c in fv.LOG_HISTOGRAM_FEATURES else F.col(c).cast("double")
             for c in names}
    long = features.select(*[e.alias(c) for c, e in shown.items()]).unpivot([], names, "feature", "value")
    return histogram(long, F.col("value"), bins, ["feature"])


def score_quartiles(recs: DataFrame, by: str = "category") -> DataFrame:
    """Box-plot numbers of the priority score per group."""
    quartiles = exact_quantiles(recs, ["priority_score"], list(QUARTILES.values()), [by])
    wide = quartiles.groupBy(by).agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for name, p in QUARTILES.items()])
    spread = recs.groupBy(by).agg(F.min("priority_score").alias("low"), F.max("priority_score").alias("high"))
    return spread.join(wide, by).select(by, "low", *QUARTILES, "high")


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair, rows of (a, b, r); null when constant.

    A row becomes an array that is paired with itself by position, so one
    narrow aggregate with a fixed number of groups serves any number of
    columns. A pair uses its complete rows.
    """
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                       for i, j in combinations_with_replacement(range(len(columns)), 2)])
    numbers = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    pairs = numbers.select("v", F.inline(places)).select("i", "j", F.get("v", "i").alias("x"), F.get("v", "j").alias("y"))
    moments = pairs.groupBy("i", "j").agg(F.corr("x", "y").alias("r"), F.stddev_pop("x").alias("spread"))
    r = F.when(F.col("i") == F.col("j"), F.when(F.col("spread") > 0, F.lit(1.0))).otherwise(F.when(~F.isnan("r"), F.col("r")))
    both = moments.select(r.alias("r"), F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("p"))
    names = F.lit(columns)
    return both.select(F.get(names, "p.i").alias("a"), F.get(names, "p.j").alias("b"), "r")


def _per_column(df: DataFrame, columns: list[str], measures: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Measures of each column: rows of (feature, measures...), also for an empty frame.

    The columns become an array that is taken apart by position. One narrow
    aggregate with an integer key compiles to compact code for any number of
    columns and combines map-side; its result has a row per column, so it is
    broadcast to the list of names.
    """
    numbers = df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("_place", "value"))
    found = numbers.groupBy("_place").agg(*[measure(F.col("value")).alias(name) for name, measure in measures.items()])
    names = df.sparkSession.range(0, 1, 1, 1).select(F.posexplode(F.lit(columns)).alias("_place", "feature"))
    shown = [F.coalesce(name, F.lit(0)).alias(name) if name == "count" else name for name in measures]
    return names.join(F.broadcast(found), "_place", "left").select("feature", *shown)


def _basic_measures() -> dict[str, Callable[[Column], Column]]:
    return {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def _null_share(value: Column) -> Column:
    return F.avg(value.isNull().cast("int"))


def feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, max and missing percentage of each column."""
    return _per_column(df, columns, {
        "count": F.count, **_basic_measures(), "missing_pct": lambda v: _null_share(v) * 100})


def monitor_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """mean, std, min, max and null rate of each column."""
    return _per_column(df, columns, {**_basic_measures(), "null_rate": _null_share})


def feature_groups(features: list[str]) -> list[tuple[str, str]]:
    """(group, feature) pairs; a feature may be in several groups."""
    return [(group, f) for group, words in fv.FEATURE_GROUPS.items()
            for f in features if any(w in f for w in words)]


def with_groups(rows: DataFrame) -> DataFrame:
    """One row per feature and group that it is in."""
    member = [F.when(F.greatest(*[F.col("feature").contains(w) for w in words])
                     if len(words) > 1 else F.col("feature").contains(words[0]), F.lit(group))
              for group, words in fv.FEATURE_GROUPS.items()]
    return rows.withColumn("feature_group", F.explode(F.array_compact(F.array(*member))))


def feature_group_importance(importance: DataFrame) -> DataFrame:
    """Importance of each feature group: its features' sum, its features, and the strongest of them."""
    return with_groups(importance).groupBy("feature_group").agg(
        F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("n_features"),
        F.max_by("feature", F.struct("importance", "feature")).alias("strongest"))


def feature_group_stats(stats: DataFrame) -> DataFrame:
    """Number of features and mean missing rate of each feature group."""
    return with_groups(stats).groupBy("feature_group").agg(
        F.count(F.lit(1)).alias("n_features"), F.min("feature").alias("first_feature"),
        F.avg("missing_pct").alias("mean_missing_pct"))
