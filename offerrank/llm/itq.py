"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Iterative quantisation (Gong and Lazebnik) rotates the principal components
of unit vectors so that their signs lose as little as possible. ``ROTATIONS``
rotations from different starts give up to 64 bits each. The code is cut into
substrings of ``TABLE_BITS`` bits, one table each: vectors of equal label that
agree in a whole substring meet, so all that differ in fewer bits than there
are tables do. Vectors that meet only by chance are told by the whole code;
the rest are compared with their original vectors in double precision.

Equal vectors of a label are one class with a size, so copies are never
paired. Vectors are moved only to buckets where they have a candidate. A pair
is judged in the first table where it meets, so links are counted once; what
leaves a bucket is a number of links per class and the links that connect what
is connected, never all pairs. A bucket of more than ``TILE`` classes is dealt
out in pairs of parts, each a group of its own.

The rotations are learnt from at most ``SAMPLE`` classes (those with the
smallest hash); all vectors are indexed. Vectors that are null, zero, or hold
null or non-finite components, and those with a null label, link with nothing
and are components of their own. Only vectors of equal length are compared.
Rows repeated count each; null ids are counted in links but never name a
component. An empty table gives an empty result; only the named columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerrank.llm.common import Scratch, components, in_batches, ordered_index, runs, table, whole_groups

MIN_COSINE = 0.93
SAMPLE = 20_000
ROTATIONS = 3
TABLE_BITS = 12
TILE = 2048


def learn(x: np.ndarray, rotations: int = ROTATIONS, rounds: int = 40, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and projection (dimension x bits) of each rotation."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0)
    bits = min(x.shape[1], 64)
    _, axes = np.linalg.eigh(np.cov((x - mean).T).reshape(x.shape[1], x.shape[1]) if len(x) > 1 else np.eye(x.shape[1]))
    axes = axes[:, ::-1][:, :bits]
    v, out = (x - mean) @ axes, []
    for _ in range(rotations):
        turn, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
        out.append((mean, axes @ turn))
    return out


def substrings(x: np.ndarray, model: list, table_bits: int = TABLE_BITS) -> np.ndarray:
    """Unit vectors to table keys (rows x tables)."""
    bits = np.concatenate([((x - mean) @ turn >= 0) for mean, turn in model], axis=1)
    tables = max(1, bits.shape[1] // table_bits)
    cut = bits[:, :tables * table_bits] if bits.shape[1] >= table_bits else bits
    weight = 1 << np.arange(cut.shape[1] // tables)
    return (cut.reshape(len(x), tables, -1) * weight).sum(2).astype(np.int32)


def vector_batches(kind: str):
    """Raw bytes of valid vectors, null for others."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = []
            for v in b.column(2):
                x = None if v.values is None or v.values.null_count else v.values.to_numpy().astype(kind)
                good = x is not None and len(x) and np.isfinite(x).all() and x.any()
                raw.append(x.tobytes() if good and np.isfinite(np.linalg.norm(x.astype(np.float64))) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], ["id", "label", "vec"])
    return work


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def key_batches(models: dict, kind: str):
    """A row for each class and table: key, class, all table keys."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, raw, cls = b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(0).to_numpy()
            dims = np.array([len(r) for r in raw])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                subs = substrings(unit([raw[k] for k in at], kind), models[int(dim)])
                codes = [s.tobytes() for s in subs]
                for t in range(subs.shape[1]):
                    keys = [f"{dim}:{t}:{s}:{label[k]}" for k, s in zip(at, subs[:, t])]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(cls[at]), pa.array(codes, pa.binary())], ["key", "cls", "code"])
    return work


def first_here(a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """Which pairs (rows of a x rows of b) meet in table ``t`` and in none before."""
    met = a[:, None, t] == b[None, :, t]
    for before in range(t):
        met &= a[:, None, before] != b[None, :, before]
    return met


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(a[:, None, t] ^ b[None, :, t]).astype(np.int16) for t in range(a.shape[1]))


def candidate_batches(max_share: float):
    """Classes with a candidate in their bucket of at most one tile: key, class, part and parts of the bucket."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches):
            keys, cls, codes = g.column(0).to_pylist(), g.column(1).to_numpy(), g.column(2).to_pylist()
            out = []
            for s, n in zip(*runs(np.array(keys, object))):
                if n == 1:
                    continue
                t = int(keys[s].split(":", 2)[1])
                subs = np.stack([np.frombuffer(c, np.int32) for c in codes[s:s + n]])
                near = np.zeros(n, bool)
                for k in range(0, n, 256):
                    part = subs[k:k + 256]
                    good = first_here(part, subs, t) & (differing(part, subs) <= max_share * TABLE_BITS * subs.shape[1])
                    good[np.arange(len(part)), np.arange(k, k + len(part))] = False
                    near[k:k + 256] = good.any(1)
                out.extend((keys[s], cls[s + k], 0, 1) for k in np.flatnonzero(near))
            if out:
                k, c, p, n = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c, pa.int64()), pa.array(p, pa.int32()), pa.array(n, pa.int32())],
                                                 ["key", "cls", "part", "parts"])
    return work


def verify_batches(models: dict, kind: str, min_cosine: float):
    """Links inside each group: per class the vectors it links to (``other`` null), and links that connect the group."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches):
            keys = np.array(g.column(0).to_pylist(), object)
            cls, part, raw, size = g.column(1).to_numpy(), g.column(2).to_numpy(), g.column(3).to_pylist(), g.column(4).to_numpy()
            rows = []
            for s, n in zip(*runs(keys)):
                if n == 1:
                    continue
                x = unit(raw[s:s + n], kind)
                subs, t = substrings(x, models[len(raw[s])]), int(keys[s].split(":", 2)[1])
                ids, sizes, parts = cls[s:s + n], size[s:s + n], part[s:s + n]
                cross = parts[:, None] != parts[None, :] if (parts != parts[0]).any() else None
                links, root = np.zeros(n, np.int64), np.arange(n)
                for k in range(0, n, 256):
                    good = (x[k:k + 256] @ x.T >= min_cosine) & first_here(subs[k:k + 256], subs, t)
                    good[np.arange(len(good)), np.arange(k, k + len(good))] = False
                    if cross is not None:
                        good &= cross[k:k + 256]
                    links[k:k + 256] = good @ sizes
                    for i in np.flatnonzero(good.any(1)):  # connect i and what it links to by one link each
                        ends = np.unique(root[np.r_[i + k, np.flatnonzero(good[i])]])
                        for e in ends[1:]:
                            rows.append((ids[ends[0]], ids[e], 0))
                            root[root == e] = ends[0]
                rows.extend((ids[i], None, links[i]) for i in np.flatnonzero(links))
            if rows:
                a, b, n = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["cls", "other", "n"])
    return work


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", tile: int = TILE) -> DataFrame:
    """One row per row: ``id``, ``n_links`` (other vectors linked directly), ``component`` (smallest id reachable)."""
    scratch = Scratch(vectors.sparkSession)
    kind = "<f4" if isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"
    array = "array<float>" if kind == "<f4" else "array<double>"
    rows = in_batches(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast(array).alias("v")),
                      vector_batches(kind), "id long, label string, vec binary")
    rows = scratch.write(rows, "itq-rows")
    classes = rows.filter("vec is not null and label is not null").groupBy("label", "vec").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    classes = scratch.write(ordered_index(classes, ["label", "vec"], scratch, "itq-order").withColumnRenamed("idx", "cls"), "itq-classes")
    models = {}
    for r in classes.select(F.octet_length("vec").alias("dim")).distinct().collect():
        some = classes.filter(F.octet_length("vec") == r["dim"]).orderBy(F.xxhash64("vec", "label")).limit(sample).select("vec").collect()
        models[r["dim"]] = learn(unit([bytes(s["vec"]) for s in some], kind))
    # twice the share of bits that random planes would put between vectors at the least cosine
    max_share = min(1.0, 2 * float(np.arccos(min_cosine)) / np.pi + 0.05)
    keyed = in_batches(classes.select("cls", "label", "vec"), key_batches(models, kind), "key string, cls long, code binary")
    counts = scratch.write(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "itq-counts")
    keyed = keyed.join(counts, "key")
    parts = F.ceil(F.col("n") / tile).cast("int")
    hot = keyed.filter(F.col("n") > tile).select("key", "cls", F.pmod(F.xxhash64("cls"), parts).cast("int").alias("part"), parts.alias("parts"))
    small = keyed.filter(F.col("n") <= tile).select("key", "cls", "code").repartition("key").sortWithinPartitions("key", "cls")
    met = in_batches(small, candidate_batches(max_share), "key string, cls long, part int, parts int").unionByName(hot)
    met = scratch.write(met, "itq-met")
    dealt = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("cls", "part", F.concat_ws(":", "key", F.least("part", "with").cast("string"), F.greatest("part", "with").cast("string")).alias("key"))
    grouped = dealt.join(classes.select("cls", "vec", "size"), "cls").select("key", "cls", "part", "vec", "size").repartition("key")
    found = in_batches(grouped.sortWithinPartitions("key", "cls"), verify_batches(models, kind, min_cosine), "cls long, other long, n long")
    found = scratch.write(found, "itq-found")
    counts = found.filter("other is null").groupBy("cls").agg(F.sum("n").alias("n"))
    labels = components(found.filter("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")), scratch, "itq-links")
    labels = labels.select(F.col("node").alias("cls"), F.col("label").alias("least"))
    joined = (classes.join(counts, "cls", "left").join(labels, "cls", "left").withColumn("root", F.coalesce("least", "cls"))
              .select("label", "vec", "first", "root", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    joined = scratch.write(joined, "itq-joined")
    smallest = joined.groupBy("root").agg(F.min("first").alias("component"))
    named = joined.join(smallest, "root").select("label", "vec", "n_links", "component")
    valid = F.col("vec").isNotNull() & F.col("label").isNotNull()
    return (rows.filter(valid).join(named, ["label", "vec"]).select("id", "n_links", "component")
            .union(rows.filter(~valid).select("id", F.lit(0).cast("long"), "id")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
