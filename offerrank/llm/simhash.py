"""SimHash near-duplicates found by Golay-code fuzzy hashing.

The 64 bits of a fingerprint are cut into segments of 21, 21 and 22 bits. The
perfect binary Golay code of length 23 corrects three errors, so every segment
(padded with zeros) decodes to one codeword. A segment's keys are the codeword
indices that it and its one-bit neighbours decode to, one to six of them: two
segments that differ in at most two bits share a key, because the vector half
way between them decodes to it.

Pigeonhole for at most four differing bits in three segments: either some
segment is equal, and then one of the other two differs in at most two bits;
or all three differ, by (1, 1, 1) to (2, 1, 1) bits. The first case meets in a
table keyed by an equal segment and a Golay key of another (six tables), the
second in a table keyed by a Golay key of each. Rows that meet are verified.

Null texts count as empty; a text without words has fingerprint zero. Rows
with equal fingerprints are one node, so copies are never paired. Rows with a
null id get a fingerprint and a component but never name it. Repeated rows
each come back. An empty table gives an empty result. Only the id and the
text column are read, so extra columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerrank.llm.common import Scratch, components, in_batches, runs, table, text_hash, whole_groups

SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit, bits
MAX_BITS = 4
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
CHUNK = 1 << 16
DENSE = 32


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    begin, end = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(begin[k:k + CHUNK], end[k:k + CHUNK])], np.uint64)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def fingerprint_batches(shingle: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), *b.columns[2:]], ["id", "fp", *b.schema.names[2:]])
    return work


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each 12-bit message, and the error of at most three bits for each syndrome."""
    def remainder(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    rest = np.array([remainder(m << 11) for m in range(4096)], np.int64)
    bits = [1 << i for i in range(23)]
    error = np.zeros(2048, np.int64)
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):  # equal places: fewer errors
                e = bits[i] | bits[j] | bits[k]
                error[remainder(e)] = e
    error[0] = 0
    return rest, error


def segment_keys(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices (rows x 6) of the segments and their one-bit neighbours; which are real."""
    rest, error = golay()
    near = v[:, None] ^ np.array([0, *(1 << i for i in range(width))], np.int64)
    index = np.sort((near ^ error[rest[near >> 11] ^ (near & 2047)]) >> 11, axis=1)
    new = np.c_[np.ones((len(v), 1), bool), index[:, 1:] != index[:, :-1]]
    order = np.argsort(~new, axis=1, kind="stable")[:, :6]
    return np.take_along_axis(index, order, 1), np.take_along_axis(new, order, 1)


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints: key, place of the fingerprint."""
    u = fp.astype(np.uint64)
    segments = [((u >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    coded = [segment_keys(s, width) for s, (_, width) in zip(segments, SEGMENTS)]
    keys, rows = [], []

    def add(tag: int, value: np.ndarray, real: np.ndarray) -> None:
        keys.append((value | tag << 40)[real])
        rows.append(np.nonzero(real)[0])

    for a in range(3):
        for b in range(3):
            if a != b:
                add(1 + 3 * a + b, segments[a][:, None] << 12 | coded[b][0], coded[b][1])
    (x, rx), (y, ry), (z, rz) = coded
    n = len(fp)
    add(0, (x[:, :, None, None] << 24 | y[:, None, :, None] << 12 | z[:, None, None, :]).reshape(n, -1),
        (rx[:, :, None, None] & ry[:, None, :, None] & rz[:, None, None, :]).reshape(n, -1))
    return np.concatenate(keys), np.concatenate(rows)


def key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy()
        for k in range(0, len(fp), 1024):
            part = fp[k:k + 1024]
            keys, rows = keys_of(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "fp"])


def distance(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    """Differing bits; of unsigned numbers, as numpy counts the bits of an absolute value."""
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64))


def spanning(fp: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is connected in one large bucket, each node once."""
    left = fp.copy()
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = distance(left, np.int64(at)) <= max_bits
            if near.any():
                found, left = left[near], left[~near]
                yield np.full(len(found), at), found
                front.extend(found.tolist())


def link_batches(max_bits: int):
    """Verified links among the fingerprints of each bucket; rows come sorted by key."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            key, fp = t.column(0).to_numpy(), t.column(1).to_numpy()
            starts, sizes = runs(key)
            found = []
            small = np.repeat(sizes <= DENSE, sizes)
            k, f = key[small], fp[small]
            for step in range(1, int(sizes[sizes <= DENSE].max(initial=1))):
                near = (k[:-step] == k[step:]) & (distance(f[:-step], f[step:]) <= max_bits)
                found.append((f[:-step][near], f[step:][near]))
            for s, n in zip(starts[sizes > DENSE], sizes[sizes > DENSE]):
                found.extend(spanning(fp[s:s + n], max_bits))
            if found:
                pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
    return work


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a``, ``b``: verified links between different fingerprints (column ``fp``, distinct rows).

    Small buckets give every link, large ones enough to connect what is
    connected, so a dense group never turns into all its pairs.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the segments find up to {MAX_BITS} differing bits")
    keys = in_batches(fingerprints, key_batches, "key long, fp long").repartition("key")
    return in_batches(keys.sortWithinPartitions("key", "fp"), link_batches(max_bits), "a long, b long").distinct()


def linked_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """``a``, ``b``: ids of rows whose fingerprints are linked; rows of one fingerprint are linked to its smallest id only."""
    scratch = Scratch(docs.sparkSession)
    marked = scratch.write(in_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
                                      fingerprint_batches(shingle), "id long, fp long"), "simhash")
    nodes = scratch.write(marked.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    same = marked.join(nodes, "fp").select(F.col("first").alias("a"), F.col("id").alias("b"))
    ends = [nodes.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in ("a", "b")]
    apart = links(nodes.select("fp"), max_bits).join(ends[0], "a").join(ends[1], "b").select("first_a", "first_b")
    return scratch.write(same.union(apart).filter("a <> b").distinct(), "simhash-pairs")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``fp`` (signed), ``component`` (smallest id reachable by links), ``text_hash`` (XXH64)."""
    scratch = Scratch(docs.sparkSession)
    marked = scratch.write(in_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_hash(text_col)),
                                      fingerprint_batches(shingle), "id long, fp long, text_hash long"), "simhash")
    nodes = scratch.write(marked.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    found = components(links(nodes.select("fp"), max_bits), scratch, "simhash-links")
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("label", "fp"))
    rooted = scratch.write(rooted.select("fp", "first", "root"), "simhash-roots")
    first = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.select("fp", "root").join(first, "root").select("fp", "component")
    return marked.join(named, "fp").select("id", "fp", "component", "text_hash")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))
