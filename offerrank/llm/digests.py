"""Exact deduplication against a persistent digest index.

The index is a table of SHA-256 digests in a folder, bucketed and sorted by
digest. A load of new texts is reduced to one row per digest, anti-joined with
the index by sort-merge, and what is new is appended as a part of its own: the
index is neither shuffled nor rewritten. A digest seen before adds a row with
its count only, so group sizes are those of all loads. Loading a part again
replaces it, so a job that failed half way is simply repeated. ``compact``
folds all parts into one; its result becomes current by one written row.

Texts are equal when they are identical; null counts as empty. Of the first
load that has a text, the row with the largest id stays; null ids are less than
all others, and of rows that repeat id and text one stays. An empty table loads
nothing and gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerrank.llm.common import Scratch, scratch_path, table

ROWS_PER_BUCKET = 2_000_000
LEAST_BUCKETS = 16


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digest``, ``id``, ``copies``: rows that repeat id and text are one, so no task gets all copies of a text."""
    rows = docs.select(digest(F.col(text_col)).alias("digest"), F.col(id_col).cast("long").alias("id"))
    return rows.groupBy("digest", "id").agg(F.count("*").alias("copies"))


class DigestIndex:
    """An index in ``path``; every session that can reach the folder can open it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: int) -> "DigestIndex":
        """An empty index with buckets for ``rows`` texts; more fit, in larger buckets."""
        index = cls(spark, path)
        index._become(0, max(LEAST_BUCKETS, -(-rows // ROWS_PER_BUCKET)))
        return index

    def _become(self, generation: int, buckets: int) -> None:
        row = self.spark.range(0, 1, 1, 1).select(F.lit(generation).alias("generation"), F.lit(buckets).alias("buckets"))
        row.write.mode("append").parquet(f"{self.path}/current")

    def _open(self) -> tuple[int, int]:
        row = self.spark.read.parquet(f"{self.path}/current").orderBy(F.desc("generation")).first()
        return row["generation"], row["buckets"]

    def _table(self, generation: int, buckets: int) -> str:
        """The catalog's name of a generation; its files are the index, the name lasts as long as the session."""
        name = f"digests_{hashlib.md5(self.path.encode()).hexdigest()}_{generation}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"""CREATE TABLE {name} (digest BINARY, keep_id BIGINT, n BIGINT, part STRING) USING parquet PARTITIONED BY (part)
                               CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/digests-{generation}'""")
        self.spark.catalog.refreshTable(name)
        return name

    def entries(self) -> DataFrame:
        """All rows: ``digest``, ``keep_id``, ``n`` (texts of that load), ``part``."""
        return self.spark.table(self._table(*self._open()))

    def fresh(self, groups: DataFrame, part: str) -> DataFrame:
        """The rows of ``groups`` (one per digest) that no other part of the index has."""
        return groups.hint("merge").join(self.entries().filter(F.col("part") != part), "digest", "left_anti")

    def add(self, rows: DataFrame, part: str) -> None:
        """Load the rows of :func:`digests` as ``part``; what that part held before is replaced."""
        generation, buckets = self._open()
        groups = rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("n")).repartition(buckets, "digest")
        scratch = Scratch(self.spark)
        groups = scratch.write(groups, "digest-groups").repartition(buckets, "digest")
        known = self.totals(part).select("digest", "keep_id")
        again = groups.drop("keep_id").hint("merge").join(known, "digest").select("digest", "keep_id", "n")
        both = self.fresh(groups, part).unionByName(again).select("digest", "keep_id", "n", F.lit(part).alias("part"))
        self._replace(both, generation, buckets)
        scratch.drop("digest-groups")

    def _replace(self, rows: DataFrame, generation: int, buckets: int) -> None:
        """Write the parts in ``rows``, in place of those of the same name; other parts stay as they are."""
        key = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "dynamic")
        try:
            rows.write.mode("overwrite").insertInto(self._table(generation, buckets))
        finally:
            self.spark.conf.set(key, before)

    def totals(self, but: str | None = None) -> DataFrame:
        """``digest``, ``keep_id``, ``n`` over all parts (or all but one); the buckets are summed where they lie."""
        entries = self.entries() if but is None else self.entries().filter(F.col("part") != but)
        return entries.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def compact(self) -> None:
        """Fold all parts into one. Parts loaded before can then not be replaced any more."""
        generation, buckets = self._open()
        folded = self.totals().select("digest", "keep_id", "n", F.lit("folded").alias("part"))
        self._replace(folded, generation + 1, buckets)
        self._become(generation + 1, buckets)

    def judge(self, rows: DataFrame) -> DataFrame:
        """``id``, ``digest``, ``keep_id``, ``group_size``, ``kept`` for the loaded rows of :func:`digests`.

        Only digests of several texts are joined, as a table of its own, so that a text of very many ids is split.
        """
        several = Scratch(self.spark).write(self.totals().filter("n > 1"), "digest-several")
        joined = rows.join(several, "digest", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
        return joined.select("id", "digest", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
                             (F.col("id").eqNullSafe(keep) & (F.col("copy") == 1)).alias("kept"))


def deduplicate(docs: DataFrame, index: DigestIndex, part: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Load ``docs`` into ``index`` and judge their rows against all that it holds."""
    rows = Scratch(docs.sparkSession).write(digests(docs, id_col, text_col), "digest-rows")
    index.add(rows, part)
    return index.judge(rows)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads, the larger ids first, so that the largest id of each text stays."""
    rows = Scratch(spark).write(digests(table(spark, sf_dir, "documents")), "digest-rows")
    low, high, n = rows.agg(F.min("id"), F.max("id"), F.count("*")).first()
    index = DigestIndex.create(spark, scratch_path(spark, "digest-index"), n)
    first = F.coalesce(F.col("id") >= F.lit(low or 0) + F.lit((high or 0) - (low or 0)) / 2, F.lit(False))
    index.add(rows.filter(first), "upper")
    index.add(rows.filter(~first), "lower")
    return index.judge(rows).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY text) AND row_number() OVER (PARTITION BY text, doc_id) = 1 AS kept,
       sha256(text) AS text_sha256
FROM texts
"""
