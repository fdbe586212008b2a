"""Approve/reject feedback: statistics, adjusted targets, oversampling, models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerrank import fixed_values as fv
from offerrank.functions.scalar import one_row


def decided(feedback: DataFrame) -> DataFrame:
    """Approvals and rejections only."""
    return feedback.where(F.col("feedback").isin("approved", "rejected"))


def load_feedback(feedback: DataFrame) -> DataFrame:
    """Approvals and rejections, newest first."""
    return decided(feedback).select(
        "member_id", "offer_id", "feedback", "feedback_text", "feedback_time"
    ).orderBy(F.desc("feedback_time"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Totals, distinct members and offers, approval rate; zeros when empty."""
    by_member = feedback.groupBy("member_id").agg(F.count(F.lit(1)).alias("n"))
    by_offer = feedback.groupBy("offer_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("feedback") == "approved").alias("approved"),
        F.count_if(F.col("feedback") == "rejected").alias("rejected"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return by_offer.agg(
        total.alias("total"), F.coalesce(F.sum("approved"), F.lit(0)).alias("approved"),
        F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"), F.count("offer_id").alias("unique_offers"),
    ).withColumns({
        "unique_members": one_row(by_member.agg(F.count("member_id").alias("n")))["n"],
        "approval_rate": F.when(F.col("total") > 0, F.col("approved") / F.col("total")).otherwise(0.0)})


def feedback_by_offer(feedback: DataFrame) -> DataFrame:
    approved = F.col("feedback") == "approved"
    return feedback.groupBy("offer_id").agg(
        F.count_if(approved).alias("approved"), F.count_if(F.col("feedback") == "rejected").alias("rejected"),
        F.avg(approved.cast("int")).alias("approval_rate"))


def feedback_totals(feedback: DataFrame) -> DataFrame:
    """All feedback per offer, comments included, largest first."""
    return feedback.groupBy("offer_id").agg(
        F.count(F.lit(1)).alias("total_feedback"),
        F.count_if(F.col("feedback") == "approved").alias("approvals"),
        F.count_if(F.col("feedback") == "rejected").alias("rejections"),
    ).orderBy(F.desc("total_feedback"), "offer_id")


def retrain_gate(feedback: DataFrame, minimum: int = fv.MIN_FEEDBACK_COUNT) -> DataFrame:
    return feedback.agg(F.count(F.lit(1)).alias("total")).select(
        "total", (F.col("total") >= minimum).alias("retrain"))


# --- clamped adjustments ------------------------------------------------------
# One adjustment maps a score s to min(high, max(low, s + shift)). Applying two
# in turn is again such a map, so a long ordered run can be folded in pieces.
ADJUSTMENT_SCHEMA = ("member_id STRING, offer_id STRING, latest TIMESTAMP, latest_id BIGINT, "
                     "shift DOUBLE, low DOUBLE, high DOUBLE")


def _compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Rows of (shift, low, high): ``first`` is applied before ``then``."""
    shift = first[:, 0] + then[:, 0]
    low, high = (np.clip(first[:, i] + then[:, 0], then[:, 1], then[:, 2]) for i in (1, 2))
    return np.column_stack([shift, low, high])


def _fold_runs(run: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """Compose the maps of each run of equal numbers, in row order."""
    while len(run) > 1 and (run[1:] == run[:-1]).any():
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        place = np.arange(len(run)) - np.repeat(starts, np.diff(np.r_[starts, len(run)]))
        head = place % 2 == 0
        paired = head & np.r_[run[1:] == run[:-1], False]
        at = np.flatnonzero(paired)
        maps = maps.copy()
        maps[at] = _compose(maps[at], maps[at + 1])
        run, maps = run[head], maps[head]
    return maps


def _fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold neighbouring rows of the same member and offer, across batches."""
    pending = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if pending is not None:
            table = pa.concat_tables([pending, table])
        if not table.num_rows:
            continue
        pairs = table.select(["member_id", "offer_id"]).to_pandas()
        changed = (pairs != pairs.shift()).any(axis=1).to_numpy()
        changed[0] = True
        maps = np.column_stack([table[c].to_numpy() for c in ("shift", "low", "high")])
        folded = _fold_runs(np.cumsum(changed), maps)
        result = table.take(pa.array(np.flatnonzero(changed)))
        for i, name in enumerate(("shift", "low", "high")):
            at = table.schema.get_field_index(name)
            result = result.set_column(at, table.schema.field(at), pa.array(folded[:, i]))
        pending = result.slice(result.num_rows - 1)
        if result.num_rows > 1:
            yield from result.slice(0, result.num_rows - 1).combine_chunks().to_batches()
    if pending is not None:
        yield from pending.combine_chunks().to_batches()


def feedback_adjustments(feedback: DataFrame, approved: float = fv.APPROVED_BOOST,
                         rejected: float = fv.REJECTED_PENALTY) -> DataFrame:
    """One adjustment (shift, low, high) per member and offer, newest row first.

    Rows are range-partitioned by member, offer and time, so a pair that owns
    many rows spreads over tasks; each task folds its stretch of the order, and
    the few stretches of a pair are put together at the end.
    """
    is_approved = F.col("feedback") == "approved"
    steps = feedback.select(
        "member_id", "offer_id", F.col("feedback_time").alias("latest"),
        F.col("feedback_id").cast("bigint").alias("latest_id"),
        F.when(is_approved, F.lit(approved)).otherwise(F.lit(rejected)).alias("shift"),
        F.when(is_approved, F.lit(float("-inf"))).otherwise(F.lit(0.0)).alias("low"),
        F.when(is_approved, F.lit(100.0)).otherwise(F.lit(float("inf"))).alias("high"))
    order = [F.col("member_id"), F.col("offer_id"), F.desc("latest"), F.desc("latest_id")]
    stretches = (steps.repartitionByRange(*order).sortWithinPartitions(*order)
                 .mapInArrow(_fold_sorted, ADJUSTMENT_SCHEMA))
    parts = F.sort_array(F.collect_list(F.struct(
        (-F.unix_micros("latest")).alias("age"), (-F.col("latest_id")).alias("id"), "shift", "low", "high")))
    start = F.struct(F.lit(0.0).alias("shift"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    limit = lambda x, p: F.greatest(p["low"], F.least(p["high"], x))
    step = lambda a, p: F.struct(
        (a["shift"] + p["shift"]).alias("shift"), limit(a["low"] + p["shift"], p).alias("low"),
        limit(a["high"] + p["shift"], p).alias("high"))
    return (stretches.groupBy("member_id", "offer_id").agg(parts.alias("_parts"))
            .select("member_id", "offer_id", F.aggregate("_parts", start, step).alias("_a"))
            .select("member_id", "offer_id", "_a.*"))


def adjust_targets(scores: DataFrame, feedback: DataFrame, approved: float = fv.APPROVED_BOOST,
                   rejected: float = fv.REJECTED_PENALTY) -> DataFrame:
    """Long scores with ``adjusted_score``; feedback on unknown pairs is ignored."""
    adjustments = feedback_adjustments(feedback, approved, rejected)
    adjusted = F.least(F.col("high"), F.greatest(F.col("low"), F.col("score") + F.col("shift")))
    return (scores.join(adjustments, ["member_id", "offer_id"], "left")
            .withColumn("adjusted_score", F.coalesce(adjusted, F.col("score")))
            .drop("shift", "low", "high"))


# --- oversampling -------------------------------------------------------------
def with_feedback(members: DataFrame, feedback: DataFrame) -> DataFrame:
    return members.join(feedback.select("member_id").distinct(), "member_id", "left_semi")


def without_feedback(members: DataFrame, feedback: DataFrame) -> DataFrame:
    return members.join(feedback.select("member_id").distinct(), "member_id", "left_anti")


def oversample_feedback(data: DataFrame, feedback: DataFrame, weight: float = fv.FEEDBACK_WEIGHT) -> DataFrame:
    """Repeat rows of members with feedback; adds copy_no and sample_weight.

    Each such row appears max(1, int(rows * weight) // rows_with_feedback)
    times with weight 2, every other row once with weight 1.
    """
    marks = feedback.select("member_id").distinct().withColumn("_has", F.lit(True))
    marked = data.join(marks, "member_id", "left")
    has = F.coalesce("_has", F.lit(False))
    counts = (data.select("member_id").join(marks, "member_id", "left")
              .agg(F.count(F.lit(1)).alias("rows"), F.count_if(has).alias("hits")))
    target = F.floor(F.col("_c.rows") * F.lit(weight))
    factor = F.when(has, F.greatest(F.lit(1), F.floor(target / F.col("_c.hits")))).otherwise(F.lit(1))
    return (marked.withColumn("_c", one_row(counts))
            .withColumn("copy_no", F.explode(F.sequence(F.lit(1), factor.cast("int"))))
            .withColumn("sample_weight", F.when(has, F.lit(fv.FEEDBACK_SAMPLE_WEIGHT)).otherwise(F.lit(1.0)))
            .drop("_has", "_c"))


# --- model versions -----------------------------------------------------------
METRICS_SCHEMA = "version INT, alias STRING, rmse DOUBLE, mae DOUBLE, r2 DOUBLE"


def latest_version(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.max("version").alias("version"))


def compare_models(metrics: DataFrame) -> DataFrame:
    """Latest challenger against the champion; without a champion alias the
    latest other version stands in, without any the challenger is better."""
    challenger = metrics.where(F.col("alias") == "challenger").agg(
        F.max_by(F.struct("version", "rmse", "r2"), "version").alias("new"))
    champion = metrics.where(~F.coalesce(F.col("alias") == "challenger", F.lit(False))).agg(
        F.max_by(F.struct("version", "rmse", "r2"),
                 F.struct(F.coalesce(F.col("alias") == "champion", F.lit(False)), "version")).alias("old"))
    joined = challenger.withColumn("old", one_row(champion)["old"]).where(F.col("new").isNotNull())
    gain_rmse, gain_r2 = F.col("old.rmse") - F.col("new.rmse"), F.col("new.r2") - F.col("old.r2")
    better = F.col("old").isNull() | (gain_rmse > 0) | (gain_r2 > fv.R2_IMPROVEMENT)
    return joined.select(F.col("new.version").alias("challenger_version"),
                         F.col("old.version").alias("champion_version"),
                         gain_rmse.alias("rmse_improvement"), gain_r2.alias("r2_improvement"),
                         better.alias("challenger_is_better"))


def promote(metrics: DataFrame, version: int) -> DataFrame:
    """Move the champion alias to ``version``; a version has at most one alias."""
    return metrics.withColumn("alias", F.when(F.col("version") == version, F.lit("champion"))
                              .when(F.col("alias") == "champion", F.lit(None)).otherwise(F.col("alias")))
