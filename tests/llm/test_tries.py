import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from offerrank.llm import tries


def turn_id(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows, shared=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, turn_id(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(said)] for c, said in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if shared else 0
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = tuple(own.get(base, [])[:h] + said[h:]) if shared else tuple(said)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, who in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(who) - 1) * len(path[-1][1]) if path else 0
    return sorted(((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, who in members.items()), key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, n int").repartition(parts)


def result(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.dtypes == [(c, "string" if c == "ends_sha256" else "bigint") for c in names]
    return sorted(map(tuple, df.collect()), key=str)


ODD = [(1, 0, "user", "a"), (1, 1, None, None), (1, None, "user", "first"), (2, 5, "user", "Ä" * 40_000), (2, 5, "user", "Ä" * 40_000), (None, 1, "user", "none"),
       (-101, 1, "user", "n"), (-100, 1, "user", "m"), (-100, 2, "user", "m2"), (100, 1, "system", "s"), (100, 2, "user", "u"), (101, 1, "x", "y"), (105, 1, "system", "s"),
       (205, 0, "", ""), (206, 0, "us", "er"), (207, 0, "use", "r"), (300, 0, "user", "q"), (301, 0, "user", "q"), (302, 0, "user", "q")]


@pytest.mark.parametrize("limit", [tries.CONTAINER, 16])
def test_odd_rows(spark, limit):
    assert result(tries.prefix_trie(frame(spark, ODD), limit, True)) == brute(ODD)


def test_empty_table(spark):
    assert tries.prefix_trie(frame(spark, []), shared_heads=True).collect() == []
    assert tries.prefix_trie(frame(spark, [(None, 1, "a", "b")])).collect() == []


def common(seed):
    """A trie with a long shared start, copies, prefixes of others and one very long conversation."""
    rng = random.Random(seed)
    rows = []
    for c in range(150):
        kind = rng.random()
        if kind < 0.3:
            said = ["start"] * 3 + [f"s{k}" for k in range(70)] + [rng.choice("ab") for _ in range(rng.randrange(4))]
        elif kind < 0.6:
            said = ["copy", "of", "all"]
        else:
            said = [rng.choice("abc") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 7))]
        rows += [(c, t, ("user", "bot")[t % 2], s) for t, s in enumerate(said)]
    return rows + [(999, t, "user", f"x{t}") for t in range(300)]


@pytest.mark.parametrize("limit,shared", [(1 << 20, False), (2000, False), (300, True), (1, False)])
def test_bursts_equal_brute_force(spark, limit, shared):
    rows = common(limit)
    assert result(tries.prefix_trie(frame(spark, rows, 7), limit, shared)) == brute(rows, shared)


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(tries.op12(spark, sf)) == brute(rows)
