"""Structured Streaming jobs: feedback counts and recommendations on request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerrank.catalog import Catalog
from offerrank.operators.ranking import recommend, with_rule_scores
from offerrank.sources import files

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_PROVIDERS = "org.apache.spark.sql.execution.streaming.state."
DEFAULT_STATE_STORE = _PROVIDERS + "HDFSBackedStateStoreProvider"
ROCKSDB_STATE_STORE = _PROVIDERS + "RocksDBStateStoreProvider"


def feedback_counts(feedback: DataFrame, window: str = "30 days", delay: str = "7 days") -> DataFrame:
    """Running feedback counts per window and offer, each event counted once.

    ``feedback`` may be a stream or a batch. ``delay`` bounds how long event ids
    and open windows are remembered after the latest event seen; rows older than
    that when they arrive are late and dropped, so it must exceed the real
    lateness.
    """
    if feedback.isStreaming:
        unique = feedback.withWatermark("feedback_time", delay).dropDuplicatesWithinWatermark(["feedback_id"])
    else:
        unique = feedback.dropDuplicates(["feedback_id"])
    return unique.groupBy(F.window("feedback_time", window).alias("_w"), "offer_id").agg(
        F.count(F.lit(1)).alias("total_feedback"),
        F.count_if(F.col("feedback") == "approved").alias("approvals"),
        F.count_if(F.col("feedback") == "rejected").alias("rejections"),
    ).select(F.col("_w.start").alias("window_start"), "offer_id", "total_feedback", "approvals", "rejections")


COUNT_KEYS = ["window_start", "offer_id"]


def _parts(spark: SparkSession, output: str) -> tuple[int | None, list[int]]:
    """The last batch that is folded into a base, and the complete batches after it."""
    bases = files.numbered(spark, f"{output}/_base", "through=")
    through = bases[-1] if bases else None
    done = files.numbered(spark, output, "batch=", "_SUCCESS")
    return through, [b for b in done if through is None or b > through]


def _changes(spark: SparkSession, output: str, through: int | None, batches: list[int]) -> DataFrame:
    """The folded counts and the changes of some batches, each row with the batch it comes from."""
    parts = []
    if batches:
        parts.append(spark.read.option("basePath", output).parquet(*[f"{output}/batch={b}" for b in batches]).withColumn("batch", F.col("batch").cast("bigint")))
    if through is not None:
        parts.append(spark.read.parquet(f"{output}/_base/through={through}"))
    if not parts:
        raise ValueError(f"no counts in {output}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _last_of_each(changes: DataFrame) -> DataFrame:
    rest = [c for c in changes.columns if c not in COUNT_KEYS]
    return changes.groupBy(*COUNT_KEYS).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*COUNT_KEYS, "_last.*")


def latest_counts(spark: SparkSession, output: str) -> DataFrame:
    """The counts as of the last complete batch that touched each window and offer."""
    return _last_of_each(_changes(spark, output, *_parts(spark, output))).drop("batch")


def compact_counts(spark: SparkSession, output: str, before: int) -> bool:
    """Fold the base and all complete batches below ``before`` into a new base.

    The new base appears by one rename under the number of its last batch, and
    readers take the highest base and only batches above it: they see the counts
    before or after, which are equal. What the base before this one replaced is
    removed now, one compaction late, so that readers that had begun can end.
    A batch that is run again after it was folded adds nothing. False if there
    was nothing to fold or another compaction of the same batches came first.
    """
    through, batches = _parts(spark, output)
    folded = [b for b in batches if b < before]
    if not folded:
        return False
    staged = files.incoming(f"{output}/_base")
    _last_of_each(_changes(spark, output, through, folded)).write.parquet(staged)
    if not files.claim(spark, staged, f"{output}/_base/through={folded[-1]}"):
        files.remove(spark, staged)
        return False
    if through is not None:
        for b in files.numbered(spark, output, "batch="):
            if b <= through:
                files.remove(spark, f"{output}/batch={b}")
        for old in files.numbered(spark, f"{output}/_base", "through="):
            if old < through:
                files.remove(spark, f"{output}/_base/through={old}")
    return True


def run_feedback_counts(stream: DataFrame, output: str, checkpoint: str, compact_every: int = 100, **options) -> DataFrame:
    """Process what has arrived, add the changed counts to ``output`` and return the counts as they stand.

    Each batch writes the windows and offers that it changed to a folder of its
    own, so a batch that is repeated after a failure replaces itself; every
    ``compact_every`` batches the ones before are folded, so at most twice as
    many folders remain. The remembered event ids are kept in RocksDB, outside
    the JVM heap, unless the session names another state store.
    """
    spark = stream.sparkSession
    if spark.conf.get(STATE_STORE, None) in (None, DEFAULT_STATE_STORE):
        spark.conf.set(STATE_STORE, ROCKSDB_STATE_STORE)
    for mark in ("batch=0", "_base"):
        _own_output(spark, output, checkpoint, f"{output}/{mark}")

    def add(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{output}/batch={batch}")
        if batch and batch % compact_every == 0:
            compact_counts(df.sparkSession, output, batch)  # the batch itself may be repeated, so it stays out

    counts = feedback_counts(stream, **options)
    query = (counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
             .foreachBatch(add).trigger(availableNow=True).start())
    query.awaitTermination()
    return latest_counts(spark, output)


def _own_output(spark: SparkSession, output: str, checkpoint: str, mark: str) -> None:
    """Refuse an output that was written with another checkpoint: it would take new batches for old ones."""
    if files.exists(spark, mark) and not files.exists(spark, f"{checkpoint}/metadata"):
        raise ValueError(f"{output} was written with another checkpoint than {checkpoint}")


def run_recommendations(requests: DataFrame, features: DataFrame, output: str, checkpoint: str, catalog: Catalog | None = None,
                        top_n: int = 5, min_score: float = 25.0) -> DataFrame:
    """Join a stream of member ids with the feature table, rank and append.

    All steps are stateless, so the file sink gives exactly-once results as
    long as an output keeps its checkpoint.
    """
    catalog = catalog or Catalog()
    spark = requests.sparkSession
    _own_output(spark, output, checkpoint, f"{output}/_spark_metadata")
    asked = requests.select("member_id").join(features, "member_id")
    recs = recommend(with_rule_scores(asked, catalog), catalog, top_n, min_score)
    query = (recs.writeStream.outputMode("append").format("parquet")
             .option("path", output).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(recs.schema).parquet(output)
