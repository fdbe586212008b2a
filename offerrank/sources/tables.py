"""Declared table schemas, readers and writers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "members": """member_id STRING, age INT, gender STRING, region STRING,
        plan_type STRING, tenure_months INT, income_bracket STRING,
        family_size INT, enrollment_date TIMESTAMP, risk_score DOUBLE,
        created_at TIMESTAMP, chronic_condition_count INT""",
    "claims": """claim_id STRING, member_id STRING, claim_date TIMESTAMP,
        claim_type STRING, diagnosis_category STRING, claim_amount DOUBLE,
        allowed_amount DOUBLE, paid_amount DOUBLE,
        member_responsibility DOUBLE, provider_type STRING,
        in_network BOOLEAN, status STRING, created_at TIMESTAMP""",
    "benefits": """member_id STRING, benefit_type STRING, annual_max DOUBLE,
        used_amount DOUBLE, remaining_balance DOUBLE, utilization_rate DOUBLE,
        last_used_date TIMESTAMP, claims_count INT, plan_year INT,
        created_at TIMESTAMP""",
    "engagement": """engagement_id STRING, member_id STRING,
        engagement_date TIMESTAMP, channel STRING, engagement_type STRING,
        response_flag BOOLEAN, session_duration_sec INT, offer_id STRING,
        created_at TIMESTAMP""",
    "feedback": """feedback_id BIGINT, member_id STRING, offer_id STRING,
        feedback STRING, feedback_text STRING, feedback_time TIMESTAMP""",
}


def normalize_timestamps(df: DataFrame) -> DataFrame:
    """Cast zone-less timestamps to TIMESTAMP; other columns stay as they are."""
    local = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in local})


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are null everywhere; NaN would spoil sums and comparisons."""
    doubles = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def read_table(spark: SparkSession, name: str, location: str) -> DataFrame:
    """Read one raw table, with its declared schema, from a folder or catalog.

    ``location`` is a path that holds ``<name>`` as parquet, or a catalog
    prefix such as ``main.health`` whose table ``<name>`` is read.
    """
    if "/" in location:
        raw = spark.read.schema(SCHEMAS[name]).parquet(f"{location.rstrip('/')}/{name}")
    else:
        raw = spark.table(f"{location}.{name}")
    return nan_to_null(normalize_timestamps(raw))


def read_raw_tables(spark: SparkSession, location: str) -> dict[str, DataFrame]:
    return {n: read_table(spark, n, location)
            for n in ("members", "claims", "benefits", "engagement")}


def table_path(catalog: str, schema: str, table: str) -> str:
    return f"{catalog}.{schema}.{table}"


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def create_schema_if_missing(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}")


def create_feedback_table(spark: SparkSession, name: str, provider: str = "parquet") -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMAS['feedback']}) USING {provider}")


def save_table(df: DataFrame, name: str, mode: str = "overwrite",
               bucket_by: tuple[str, int] | None = None) -> None:
    """Write a managed table; overwriting also replaces its schema.

    ``bucket_by=("member_id", n)`` keeps later joins and grouping on that column
    free of a shuffle.
    """
    writer = df.write.mode(mode)
    if mode == "overwrite":
        writer = writer.option("overwriteSchema", "true")
    if bucket_by:
        column, buckets = bucket_by
        writer = writer.bucketBy(buckets, column).sortBy(column)
    writer.saveAsTable(name)


def save_raw_tables(tables: dict[str, DataFrame], location: str) -> None:
    """Overwrite the raw tables under a folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{location.rstrip('/')}/{name}")


def save_by_member(tables: dict[str, DataFrame], schema: str, buckets: int, crowded: float = 4.0) -> list[str]:
    """Overwrite tables of a catalog schema, each in the same number of buckets of ``member_id``.

    Aggregates by member and joins of such tables need no shuffle. Rows are
    dealt to the buckets' tasks before they are written, so each bucket is one
    file; with about 256 MB a bucket of the largest table, 100 TB take 400,000.

    A bucket is read by one task. A table in which one member (or a missing id)
    holds more than ``crowded`` times the rows of a mean bucket is therefore
    written without buckets: its aggregates combine rows before they shuffle
    them. The result names the tables that are in buckets.
    """
    in_buckets = []
    for name, df in tables.items():
        sizes = df.groupBy("member_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
        if (sizes["most"] or 0) > crowded * max((sizes["rows"] or 0) / buckets, 1000):
            save_table(df, f"{schema}.{name}")
        else:
            save_table(df.repartition(buckets, "member_id"), f"{schema}.{name}", bucket_by=("member_id", buckets))
            in_buckets.append(name)
    return in_buckets


def save_features(features: DataFrame, path: str) -> None:
    """Feature table without the segment label, which is a report column."""
    features.drop("segment").write.mode("overwrite").parquet(path)


def save_serving(recs: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Lay recommendations out for lookups by member.

    Range partitioning plus sorted files gives narrow min/max statistics, so
    that a lookup of one member reads about one row group. The number of
    partitions follows the session's shuffle settings, the file size is bounded.
    """
    write_serving(recs.repartitionByRange("member_id", "rank"), path, rows_per_file)


def write_serving(ranged: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """:func:`save_serving` of rows that lie in ranges of members already."""
    (ranged.sortWithinPartitions("member_id", "rank")
           .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path))


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_feedback(batch: DataFrame, path: str) -> None:
    """Append feedback rows; a missing text is stored as an empty string."""
    (batch.withColumn("feedback_text", F.coalesce("feedback_text", F.lit("")))
          .write.mode("append").parquet(path))


def append_feedback_event(spark: SparkSession, path: str, feedback_id: int, member_id: str, offer_id: str, feedback: str,
                          at: datetime, text: str | None = None) -> None:
    """Append one event. The time is the caller's; without a text it is empty."""
    append_feedback(spark.createDataFrame([(feedback_id, member_id, offer_id, feedback, text, at)], SCHEMAS["feedback"]), path)
