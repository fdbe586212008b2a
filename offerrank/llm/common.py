"""Helpers that several operators of this package share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerrank.session import scratch_path, ship_package

#: Words are runs of anything but these ASCII characters (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text_col: str = "text") -> Column:
    """XXH64 of the text as ``text_hash``; with the id it tells apart rows whose id repeats. Null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash")


def in_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package sent to the executors first."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


class Scratch:
    """Tables written to the folder in ``spark.checkpoint.dir``; ``drop`` deletes those that are done with.

    A written table cuts the lineage, is read by several jobs and survives
    lost executors. What is not dropped goes when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let the session delete shuffle files of frames that are done with; otherwise they stay until the driver needs memory.

        The scheduler remembers the last job, so a tiny one comes in between.
        """
        self.spark.range(0, 1, 1, 1).write.format("noop").mode("overwrite").save()
        gc.collect()
        self.spark._jvm.System.gc()


def ordered_index(df: DataFrame, keys: list, scratch: Scratch, name: str, start: int = 0) -> DataFrame:
    """``df`` with ``idx``: each row's place in the order of ``keys``.

    Rows are range-partitioned and numbered inside their partition; only one
    count per partition comes to the driver. Rows equal in all keys may be
    numbered in either order.
    """
    from pyspark.sql import Window

    ranged = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    numbered = scratch.write(
        ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*keys))), name)
    offset, offsets = start, {}
    for part, n in sorted((r["_part"], r["n"]) for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        offsets[part] = offset
        offset += n
    if not offsets:
        return numbered.select(*df.columns, F.lit(0).cast("long").alias("idx"))
    place = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])
    return numbered.select(*df.columns, (place[F.col("_part")] + F.col("_row") - 1).cast("long").alias("idx"))


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``node``, ``label`` for all nodes of ``edges`` (``a``, ``b``): the smallest node that links reach.

    Alternates the two star steps of Kiveris et al. (2014): first every node's
    larger neighbours, then its smaller ones, move to the smallest node
    around it. Ends when a round changes nothing. Every round is written.
    """
    def smallest(pairs: DataFrame) -> DataFrame:
        near = pairs.groupBy("a").agg(F.min("b").alias("m"))
        return pairs.join(near.select("a", F.least("a", "m").alias("m")), "a")

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(20)))")).first())

    now = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before, k = digest(now), 0
    while before[0]:
        both = now.union(now.select("b", "a"))
        large = smallest(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = smallest(large.distinct())
        moved = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        k += 1
        now = scratch.write(moved.filter("a <> b").distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        after = digest(now)
        if after == before:
            break
        before = after
    return (now.select(F.col("a").alias("node"), F.col("b").alias("label"))
            .union(now.select("b", F.col("b").alias("label"))).distinct())


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.diff(np.r_[starts, len(keys)])


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no group (equal first column) is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0)
        if held and held[-1].column(0)[-1] == key[0] and key[-1] == key[0]:
            held.append(batch)  # one group goes on
            continue
        keys = key.to_numpy(zero_copy_only=False)
        cut = int(runs(keys)[0][-1])
        if cut:
            held.append(batch.slice(0, cut))
        if held:
            yield pa.Table.from_batches(held).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
