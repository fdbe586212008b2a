"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    The two operators that run Python in tasks need it there, whether or not
    the package is installed on the workers.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.join(tempfile.mkdtemp(prefix="offerrank-"), "offerrank")
        spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", root, "offerrank"))
        _shipped.add(app)


def size_shuffles(spark: SparkSession, input_bytes: int, target_bytes: int = 128 << 20) -> None:
    """Start shuffles with about ``target_bytes`` of input per partition.

    Adaptive execution merges partitions that turn out small, so the first
    number only has to be large enough.
    """
    wanted = max(8, -(-input_bytes // target_bytes))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))


def keep_compiled(spark: SparkSession) -> None:
    """Run a stage operator by operator if the code made for it is a method the JVM would only interpret.

    Java compiles no method of over 8,000 bytes; projections of some hundred
    columns get longer in one piece, while an operator alone splits its code.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; every executor can reach it.

    Only a single-JVM session (tests) may fall back to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="offerrank-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several jobs or branches need the same costly frame. A parquet
    table keeps column pruning and statistics, and survives lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
