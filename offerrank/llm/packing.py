"""Best-fit packing into bins of several permitted sizes.

A document longer than the largest permitted length is cut into pieces of that
length and a rest; nothing is dropped. Pieces are dealt by hash into groups of
a fixed average size, each packed in one task: longest first, every piece into
the open bin with the least room that still holds it. When none does, the
permitted size with the least cost per token it can still expect is opened (a
bin costs its length and a fixed overhead; what it can expect is at most what
is left of the group). The sizes are optimised jointly: each permitted length
in turn is the largest that may be opened (longer only where a piece needs it),
every bin is finally downsized to the smallest permitted length that holds its
contents, and the cheapest of these packings is kept.

Null and empty texts have one piece of length 0. Equal rows are counted
before they are dealt out, so a row repeated any number of times spreads over
all groups. An empty table gives an empty result; only the named columns are
read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerrank.llm.common import WORD, table
from offerrank.session import ship_package

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 64
GROUP = 8192


def pack_once(sizes: list[int], allowed: list[int], capacities: list[int], overhead: int) -> tuple[list[tuple[int, int]], int]:
    """Place (bin, offset) of each piece, longest first, opening only ``allowed`` sizes where they suffice; the cost after downsizing."""
    rooms: list[int] = []  # different rooms of open bins, ascending
    open_bins: dict[int, list[int]] = {}
    used: list[int] = []
    placed, left = [], sum(sizes)
    for size in sizes:
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            k = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
        else:
            fits = [c for c in allowed if c >= size] or [next(c for c in capacities if c >= size)]
            room = min(fits, key=lambda c: ((c + overhead) / max(1, min(c, left)), c))
            k = len(used)
            used.append(0)
        placed.append((k, used[k]))
        used[k] += size
        left -= size
        room -= size
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append(k)
    return placed, sum(capacities[bisect_left(capacities, u)] + overhead for u in used)


def pack_group(sizes: list[int], capacities: list[int], overhead: int) -> list[tuple[int, int]]:
    tried = [pack_once(sizes, capacities[:k + 1], capacities, overhead) for k in range(len(capacities))]
    return min(tried, key=lambda t: t[1])[0]


def packer(capacities: list[int], overhead: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "piece", "copy"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        placed = np.array(pack_group(pdf["length"].tolist(), capacities, overhead), np.int64)
        used = np.bincount(placed[:, 0], pdf["length"]).astype(np.int64)
        fitted = np.array(capacities, np.int64)[np.searchsorted(capacities, used)]
        return pdf.assign(bin_id=pdf["shard"] * (1 << 24) + placed[:, 0], capacity=fitted[placed[:, 0]], used=used[placed[:, 0]],
                          offset=placed[:, 1])[["id", "piece", "copy", "start", "length", "bin_id", "capacity", "used", "offset"]]
    return work


def pack(docs: DataFrame, capacities: tuple = CAPACITIES, overhead: int = OVERHEAD, group: int = GROUP, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: ``id``, ``piece``, ``copy``, ``start``, ``length`` (words), ``bin_id``, ``capacity``, ``used``, ``offset``."""
    ship_package(docs.sparkSession)
    sizes = sorted(set(capacities))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    equal = docs.select(F.col(id_col).alias("id"), size.alias("size")).groupBy("id", "size").agg(F.count("*").alias("n"))
    most = sizes[-1]
    pieces = (equal.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("size") / most) - 1))))
              .withColumn("start", F.col("piece") * most).withColumn("length", F.least(F.lit(most), F.col("size") - F.col("start")))
              .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))))
    total = docs.select(F.sum(F.greatest(F.lit(1), F.ceil(size / most)))).first()[0] or 0
    shards = max(1, -(-total // group))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "size", "piece", "copy"), F.lit(shards)).cast("long"))
    return dealt.select("shard", "id", "piece", "copy", "start", "length").groupBy("shard").applyInPandas(
        packer(sizes, overhead), "id long, piece long, copy long, start long, length long, bin_id long, capacity long, used long, offset long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
