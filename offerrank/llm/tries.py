"""Prefix trie of conversations by burst tries.

A turn is the digest of its role and text; a conversation is the string of its
turns' digests. Conversations with equal strings are one entry with a count.
All entries start in one container under the root. A container of more than
``CONTAINER`` bytes of suffixes bursts: its shared start is skipped, and every
entry moves on by its next turn to the container of that turn's trie head; an
entry that ends there stays as the end of the burst node. Rounds go on until no
container of several entries is too large, and only entries of burst containers
are written again. Each remaining container is then sorted in one task and
swept into nodes with a stack. What a container sums up (leaves, saved tokens)
goes to all trie heads above it in one aggregate.

The ids of the members that end at one node are hashed in order as a stream:
they are sorted by ranges, packed into texts of a batch each, and only these
texts meet, so a node where a third of all conversations end is not held.

Turns are ordered by turn (null first), equal ones by digest; null role or text
counts as empty; rows without an id belong to no conversation and are left out.
Repeated rows are turns like others. A conversation is one row of 16 bytes and
a number for each turn. An empty table has no nodes, not even a root. Only the
named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerrank.llm.common import Scratch, in_batches, runs, table, whole_groups

TURN = 16  # bytes of a digest
CONTAINER = 1 << 18
FAMILY, SHARED = 100, 6
SKIP = 64  # turns that a round can skip
NOTHING = hashlib.sha256(b"").hexdigest()
EMPTY = "cast('' as binary)"


def turn_rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv``, ``turn``, ``tid``, ``chars``; the texts end here."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    tid = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), tid.alias("tid"), F.length(text).alias("chars"))


def piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to one piece for each conversation and batch."""
    part, seq = TaskContext.get().partitionId(), 0
    for b in batches:
        conv = b.column(0).to_numpy()
        starts, sizes = runs(conv)
        if not len(starts):
            continue
        tids = b"".join(b.column(1).to_pylist())
        ends = starts + sizes
        chars = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(conv)].astype(np.int32)), b.column(2))
        yield pa.RecordBatch.from_arrays(
            [pa.array(conv[starts]), pa.array(np.full(len(starts), part, np.int32)), pa.array(np.full(len(starts), seq)),
             pa.array([tids[TURN * s:TURN * e] for s, e in zip(starts, ends)], pa.binary()), chars], ["conv", "part", "seq", "tids", "chars"])
        seq += 1


def conversations_of(turns: DataFrame) -> DataFrame:
    """``conv``, ``tids``, ``chars`` in order. Turns are sorted by ranges, so a very long conversation is packed by many tasks."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("tid")]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "tid", "chars")
    pieces = in_batches(ranged, piece_batches, "conv long, part int, seq long, tids binary, chars array<int>")
    whole = pieces.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "tids", "chars"))).alias("p"))
    return whole.select("conv", F.expr(f"aggregate(p, {EMPTY}, (a, s) -> concat(a, s.tids))").alias("tids"), F.flatten(F.col("p.chars")).alias("chars"))


def with_shared_heads(whole: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """Every conversation begins with the first turns of the first one of its family, as many as its id's CRC says."""
    heads = whole.filter(F.col("conv") % family == 0).select(
        F.col("conv").alias("base"), F.expr(f"substring(tids, 1, {TURN * shared})").alias("head"), F.slice("chars", 1, shared).alias("head_chars"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % shared).cast("int")
    joined = whole.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % family}).join(heads, "base", "left")
    return joined.select(
        "conv", F.expr(f"concat(substring(coalesce(head, {EMPTY}), 1, {TURN} * h), substring(tids, {TURN} * h + 1))").alias("tids"),
        F.expr("concat(slice(coalesce(head_chars, cast(array() as array<int>)), 1, h), slice(chars, h + 1, greatest(size(chars) - h, 0)))").alias("chars"))


def member_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv) to the ids of a key in a batch as one text."""
    part, seq = TaskContext.get().partitionId(), 0
    for b in batches:
        keys, ids = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
        starts, sizes = runs(keys)
        texts = [",".join(map(str, ids[s:s + n])) for s, n in zip(starts, sizes)]
        yield pa.RecordBatch.from_arrays([pa.array(keys[starts].tolist(), pa.binary()), pa.array([part] * len(texts), pa.int32()), pa.array([seq] * len(texts), pa.int64()), pa.array(texts)],
                                         ["key", "part", "seq", "ids"])
        seq += 1


def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted texts of each key to the hash of all of them, joined by commas."""
    now, state = None, hashlib.sha256()
    for b in batches:
        keys, out = b.column(0).to_pylist(), []
        for key, text in zip(keys, b.column(1).to_pylist()):
            if key == now:
                state.update(b",")
            else:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256()
            state.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], ["key", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends"])


def entries_of(rebuilt: DataFrame, scratch: Scratch) -> DataFrame:
    """Equal conversations as one: ``key``, ``tids``, ``chars``, ``n``, ``first`` (least id), ``ends`` (hash of all ids)."""
    entries = rebuilt.groupBy("key").agg(F.first("tids").alias("tids"), F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv").alias("first"))
    entries = scratch.write(entries, "trie-entries")
    members = rebuilt.select("key", "conv").join(entries.filter("n > 1").select("key"), "key", "left_semi")
    texts = in_batches(members.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv"), member_batches, "key binary, part int, seq long, ids string")
    ends = in_batches(texts.repartition("key").sortWithinPartitions("key", "part", "seq").select("key", "ids"), hash_batches, "key binary, ends string")
    alone = F.sha2(F.col("first").cast("string").cast("binary"), 256)
    return entries.join(ends, "key", "left").withColumn("ends", F.coalesce("ends", alone))


def sweep_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each container; its entries come sorted. The top node also has the heads above (``path``)."""
    for g in whole_groups(batches):
        head = np.array(g.column(0).to_pylist(), object)
        above, ups, at, strings, chars, counts, firsts, ends = (g.column(k).to_pylist() for k in range(1, 9))
        depth, parent, first, n, children, leaves, saved, length, end, path, up = ([] for _ in range(11))

        def close(x: int) -> None:
            leaves[x] = leaves[x] or 1
            saved[x] += (n[x] - 1) * length[x]
            p = parent[x]
            if p >= 0:
                n[p] += n[x]
                leaves[p] += leaves[x]
                saved[p] += saved[x]
                first[p] = first[x] if first[p] is None else min(first[p], first[x])

        for s, size in zip(*runs(head)):
            top, spine, before = at[s], [], None
            for k in range(s, s + size):
                now = np.frombuffer(strings[k], np.int64)
                shared = top - 1
                if before is not None:
                    m = min(len(before), len(now))
                    differ = np.flatnonzero(before[2 * top:m] != now[2 * top:m])
                    shared = (2 * top + int(differ[0])) // 2 if len(differ) else m // 2
                while len(spine) > shared - top + 1:
                    close(spine.pop())
                for d in range(shared + 1, len(now) // 2 + 1):
                    over = spine[-1] if spine else -1
                    if over >= 0:
                        children[over] += 1
                    spine.append(len(depth))
                    depth.append(d)
                    parent.append(over)
                    first.append(None)
                    n.append(0)
                    children.append(0)
                    leaves.append(0)
                    saved.append(0)
                    length.append(chars[k][d - 1] if d else 0)
                    end.append(NOTHING)
                    path.append(above[k] if over < 0 else None)
                    up.append(ups[k] if over < 0 else None)
                x = spine[-1]
                n[x], first[x], end[x], before = n[x] + counts[k], firsts[k], ends[k], now
            while spine:
                close(spine.pop())
        parents = [first[p] if p >= 0 else u for p, u in zip(parent, up)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(path, pa.binary()), *(pa.array(c, pa.int64()) for c in (first, depth, parents, n, children, leaves, saved)), pa.array(end, pa.string())],
            ["path", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])


def common_start(low: Column, high: Column) -> Column:
    """How many turns two strings share, which is what all strings between them share."""
    turns = F.floor(F.least(F.octet_length(low), F.octet_length(high)) / TURN).cast("int")
    same = F.transform(F.sequence(F.lit(0), turns), lambda i: F.substr(low, i * TURN + 1, F.lit(TURN)) == F.substr(high, i * TURN + 1, F.lit(TURN)))
    return F.when(turns == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(F.slice(same, F.lit(1), turns), False), F.lit(0)) - 1, turns)).cast("int")


def burst(entries: DataFrame, limit: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Entries in containers small enough to be swept, and the burst nodes above them.

    ``head`` names a container, ``path`` the burst heads above it, ``up`` the least id of the node above.
    """
    root = F.lit(b"\0" * TURN)
    held = scratch.write(entries.select(root.alias("head"), F.expr(EMPTY).alias("path"), F.lit(None).cast("long").alias("up"), F.lit(0).alias("depth"),
                                        "tids", "chars", "n", "first", "ends"), "trie-held-0")
    done, nodes, k = [], [], 0
    while True:
        rest = F.substr("tids", F.col("depth") * TURN + 1, F.lit(SKIP * TURN))
        large = (held.groupBy("head").agg(F.sum(F.octet_length("tids") - F.col("depth") * TURN).alias("bytes"), F.count("*").alias("entries"), F.sum("n").alias("n"),
                                          F.min("first").alias("least"), F.min(rest).alias("low"), F.max(rest).alias("high"), F.first("path").alias("path"),
                                          F.first("up").alias("up"), F.first("depth").alias("depth"))
                 .filter((F.col("bytes") > limit) & (F.col("entries") > 1))
                 .withColumn("deep", F.col("depth") + common_start(F.col("low"), F.col("high"))).drop("low", "high", "bytes", "entries"))
        large = scratch.write(large, f"trie-large-{k}")
        if large.isEmpty():
            done.append(held)
            break
        done.append(held.join(large.select("head"), "head", "left_anti"))
        moving = held.join(large.select("head", "deep", "least"), "head")
        here = F.octet_length("tids") == F.col("deep") * TURN
        one = F.col("depth") * TURN + 1
        ended = moving.filter(here).select("head", "ends")
        # what all entries of a container say between its top and its burst node
        told = moving.groupBy("head").agg(F.first(F.slice("chars", F.greatest("depth", F.lit(1)), F.col("deep") - F.greatest("depth", F.lit(1)) + 1)).alias("told"))
        nodes.append(large.join(told, "head").join(ended, "head", "left"))
        step = F.substr("tids", one, (F.col("deep") - F.col("depth") + 1) * TURN)
        held = scratch.write(moving.filter(~here).select(
            F.unhex(F.md5(F.concat("head", step))).alias("head"), F.concat("path", "head").alias("path"), F.col("least").alias("up"),
            (F.col("deep") + 1).alias("depth"), "tids", "chars", "n", "first", "ends"), f"trie-held-{k + 1}")
        k += 1
    union = done[0]
    for more in done[1:]:
        union = union.unionByName(more)
    if not nodes:
        return union, None
    heads = nodes[0]
    for more in nodes[1:]:
        heads = heads.unionByName(more)
    return union, scratch.write(heads, "trie-heads")


def head_nodes(heads: DataFrame, swept: DataFrame) -> DataFrame:
    """Nodes from the top of each burst container to where it burst, with what lies below summed up."""
    own = (F.col("n") - 1) * F.aggregate("told", F.lit(0).cast("long"), lambda a, c: a + c)
    parts = (swept.filter("path is not null").select("path", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
             .union(heads.select("path", F.lit(0).cast("long"), own)))
    parts = parts.withColumn("depth", F.floor(F.octet_length("path") / TURN).cast("int")).filter("depth > 0")
    ancestors = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda i: F.struct(
        F.substr("path", (i - 1) * TURN + 1, F.lit(TURN)).alias("head"), (i == F.col("depth")).cast("long").alias("child")))
    below = (parts.select(F.explode(ancestors).alias("a"), "leaves", "saved").groupBy("a.head")
             .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum("a.child").alias("children")))
    rows = heads.join(below, "head").withColumn("y", F.explode(F.sequence("depth", "deep")))
    last = F.col("y") == F.col("deep")
    still = F.slice("told", F.greatest(F.col("y") - F.greatest("depth", F.lit(1)) + 1, F.lit(1)), F.size("told"))
    return rows.select(
        F.col("least").alias("conv_id"), F.col("y").cast("long").alias("depth"), F.when(F.col("y") == F.col("depth"), F.col("up")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        ((F.col("n") - 1) * F.aggregate(still, F.lit(0).cast("long"), lambda a, c: a + c) + F.col("saved")).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(NOTHING))).otherwise(F.lit(NOTHING)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, container: int = CONTAINER, shared_heads: bool = False, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, counts, and the hash of the ids that end there."""
    scratch = Scratch(conversations.sparkSession)
    turns = scratch.write(turn_rows(conversations, conv_col, turn_col, role_col, text_col), "trie-turns")
    whole = scratch.write(conversations_of(turns), "trie-whole")
    rebuilt = with_shared_heads(whole) if shared_heads else whole
    rebuilt = scratch.write(rebuilt.withColumn("key", F.unhex(F.md5("tids"))), "trie-rebuilt")
    scratch.drop("trie-turns", "trie-whole")
    held, heads = burst(entries_of(rebuilt, scratch), container, scratch)
    sorted_ = held.select("head", "path", "up", "depth", "tids", "chars", "n", "first", "ends").repartition("head").sortWithinPartitions("head", "tids")
    swept = scratch.write(in_batches(sorted_, sweep_batches, "path binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
                                                             "n_leaves long, saved_tokens long, ends_sha256 string"), "trie-nodes")
    return swept.drop("path") if heads is None else swept.drop("path").unionByName(head_nodes(heads, swept))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), shared_heads=True)


SQL = """
WITH crc AS (
  SELECT DISTINCT conv_id, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
           lambda a, b: list_reduce(list_prepend(xor(a, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]),
                           lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 6 AS INTEGER) AS h
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS said FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.said[1:h], []), o.said[h + 1:]) AS said
  FROM own o JOIN crc USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
members AS (SELECT conv_id, d, said[1:d] AS path, d = len(said) AS ends FROM rebuilt, unnest(range(0, len(said) + 1)) AS u(d)),
nodes AS (
  SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY path),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
own_values AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.path[depth].text) END AS own
  FROM nodes n LEFT JOIN children c ON n.path = c.path),
below AS (
  SELECT path[1:a] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens
  FROM own_values, unnest(range(0, depth + 1)) AS u(a) GROUP BY 1)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, b.n_leaves, b.saved_tokens, o.ends_sha256
FROM own_values o JOIN below b ON o.path = b.path LEFT JOIN nodes p ON o.depth > 0 AND p.path = o.path[1:o.depth - 1]
"""
