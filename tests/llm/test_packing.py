import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from offerrank.llm import packing
from offerrank.llm.common import WORD

CAPS = [8, 16, 32]


def brute_once(sizes, allowed, overhead):
    """Best fit by looking at every open bin."""
    bins, left = [], sum(sizes)
    for s in sizes:
        fits = [b for b in bins if b[0] - b[1] >= s]
        if fits:
            b = min(fits, key=lambda b: b[0] - b[1])
        else:
            options = [c for c in allowed if c >= s] or [min(c for c in CAPS if c >= s)]
            b = [min(options, key=lambda c: ((c + overhead) / max(1, min(c, left)), c)), 0]
            bins.append(b)
        b[1] += s
        left -= s
    return sum(min(c for c in CAPS if c >= used) + overhead for _, used in bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 32), min_size=1, max_size=60), st.integers(0, 9))
def test_costs_equal_plain_best_fit(sizes, overhead):
    sizes.sort(reverse=True)
    costs = [packing.pack_once(sizes, CAPS[:k + 1], CAPS, overhead)[1] for k in range(3)]
    # bins of equal room are alike, so the cost cannot depend on which is taken
    assert costs == [brute_once(sizes, CAPS[:k + 1], overhead) for k in range(3)]
    used = Counter()
    for s, (b, at) in zip(sizes, packing.pack_group(sizes, CAPS, overhead)):
        assert at == used[b]
        used[b] += s
    assert max(used.values()) <= 32
    assert sum(min(c for c in CAPS if c >= u) + overhead for u in used.values()) == min(costs)


def check(rows, got, capacities):
    want, have, bins = Counter(), Counter(), defaultdict(list)
    for i, text in rows:
        want[i, len(re.findall(WORD, text or ""))] += 1
    whole = defaultdict(int)
    for r in got:
        whole[r.id, r.copy] += r.length
        bins[r.bin_id].append(r)
        assert r.start == r.piece * max(capacities)
    for inside in bins.values():
        inside.sort(key=lambda r: (r.offset, r.length))
        at = 0
        for r in inside:
            assert r.offset == at
            at += r.length
        assert {r.used for r in inside} == {at}
        assert {r.capacity for r in inside} == {min(c for c in capacities if c >= at)}
    for (i, _), n in whole.items():
        have[i, n] += 1
    return want, have


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack(docs).collect()
    want, have = check([(r.doc_id, r.text) for r in docs.collect()], got, packing.CAPACITIES)
    assert want == have
    words = sum(k[1] * n for k, n in want.items())
    assert sum({r.bin_id: r.capacity for r in got}.values()) < 1.1 * words


def test_edges_and_hot_row(spark):
    rows = [(7, "same row " * 3)] * 500 + [(1, None), (2, ""), (3, "w " * 9001), (None, "a b")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, length int, shard string")
    got = packing.pack(docs, group=64).collect()
    want, have = check(rows, got, packing.CAPACITIES)
    assert want == have
    assert len({r.bin_id >> 24 for r in got if r.id == 7}) > 4
    assert sorted(map(str, got)) == sorted(map(str, packing.pack(docs.repartition(5), group=64).collect()))
    assert packing.pack(docs.limit(0)).count() == 0
