import re
from collections import defaultdict

import pytest

from compare import connect, difference
from offerrank.llm import mixing


def test_equals_sql(spark, sf):
    assert difference(mixing.op1(spark, sf), mixing.SQL, connect(sf)) is None


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        out |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def rows():
    out = [(k, "w " * (k % 40 + 1), "big") for k in range(600)] + [(1000 + k, "one two", "a") for k in range(20)]
    out += [(2000 + k, "x " * 500, None) for k in range(9)] + [(3000, None, "nil"), (3001, "", "nil"), (None, "a b c", "Ä"), (None, "a b c", "Ä")]
    return out + [(4000, "q " * 70_000, "long"), (4001, "q", "long"), (4001, "q", "long")]


@pytest.fixture(scope="module")
def mixed(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows()], "doc_id long, text string, source string, size int, target int").repartition(7)
    return docs, mixing.mix(docs).collect()


def test_targets_and_amounts(mixed):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, source in rows():
        n = len(re.findall(mixing.WORD, text or ""))
        sizes[source] += n
        largest[source] = max(largest[source], n)
    targets = brute_targets(dict(sizes))
    for r in mixed[1]:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert len(mixed[1]) == len(rows())
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6


def test_reruns_agree_and_empty(mixed):
    again = mixing.mix(mixed[0].repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed[1]))
    assert mixing.mix(mixed[0].limit(0)).count() == 0


def test_long_documents_are_likelier(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 40 + 1), "ab"[k % 2]) for k in range(4000)], "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    for source in "ab":
        extra = [(r.size, r.copies) for r in out if r.source == source]
        least = min(c for _, c in extra)
        chosen = [s for s, c in extra if c > least]
        assert 0 < len(chosen) < len(extra)
        assert sum(chosen) / len(chosen) > 1.1 * sum(s for s, _ in extra) / len(extra)
