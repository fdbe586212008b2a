"""Validation and drift checks. Findings come back as rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from offerrank.operators.profile import monitor_stats


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema
            if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)]


def validate_members(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Rows of (check, n) for the checks that fail: missing columns, duplicate
    ids beyond the first (nulls are duplicates of each other), empty, null ids."""
    missing = [c for c in (required or ["member_id"]) if c not in df.columns]
    findings = [("missing_columns", F.lit(len(missing)).cast("bigint"))]
    if "member_id" in df.columns:
        sizes = df.groupBy("member_id").agg(F.count(F.lit(1)).alias("n"))
        totals = sizes.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
            F.coalesce(F.sum(F.when(F.col("member_id").isNull(), F.col("n"))), F.lit(0)).alias("nulls"))
        findings += [("duplicate_ids", F.col("duplicates")), ("null_ids", F.col("nulls"))]
    else:
        totals = df.agg(F.count(F.lit(1)).alias("rows"))
    findings.append(("empty", (F.col("rows") == 0).cast("bigint")))
    entries = [F.struct(F.lit(name).alias("check"), n.alias("n")) for name, n in findings]
    return totals.select(F.inline(F.array(*entries))).where(F.col("n") > 0)


def validate_features(df: DataFrame, names: list[str], max_null_rate: float = 0.5) -> DataFrame:
    """Rows of (check, column): missing features, infinite values, null rate
    above the limit."""
    numeric = set(numeric_columns(df))
    # other types only need to show whether they are null
    marks = df.select(*[(F.col(c).cast("double") if c in numeric else F.when(F.col(c).isNotNull(), F.lit(0.0))).alias(c)
                        for c in df.columns])
    found = marks.unpivot([], df.columns, "column", "value").groupBy("column").agg(
        F.max(F.abs("value") == float("inf")).alias("infinite"),
        (F.avg(F.col("value").isNull().cast("int")) > max_null_rate).alias("high_null_rate"))
    findings = found.unpivot(["column"], ["infinite", "high_null_rate"], "check", "hit").where("hit")
    missing = df.sparkSession.createDataFrame(
        [("missing", c) for c in names if c not in df.columns], "check STRING, column STRING")
    return findings.select("check", "column").unionByName(missing)


def check_drift(baseline: DataFrame, current: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Mean shift of each feature that both statistics tables hold.

    The shift is relative to the baseline mean, absolute when that is 0.
    """
    old = baseline.select("feature", F.col("mean").alias("baseline_mean"))
    new = current.select("feature", F.col("mean").alias("current_mean"))
    gap = F.abs(F.col("current_mean") - F.col("baseline_mean"))
    shift = F.when(F.col("baseline_mean") == 0, gap).otherwise(gap / F.abs("baseline_mean"))
    return old.join(new, "feature").withColumn("mean_change", shift).withColumn(
        "has_drift", F.coalesce(F.col("mean_change") > threshold, F.lit(False)))


class DriftMonitor:
    """Keeps baseline statistics in a table and compares later frames with it."""

    def __init__(self, path: str):
        self.path = path

    def set_baseline(self, df: DataFrame, columns: list[str] | None = None) -> None:
        monitor_stats(df, columns or numeric_columns(df)).write.mode("overwrite").parquet(self.path)

    def check(self, df: DataFrame, threshold: float = 0.1) -> DataFrame:
        baseline = df.sparkSession.read.parquet(self.path)
        return check_drift(baseline, monitor_stats(df, numeric_columns(df)), threshold)
