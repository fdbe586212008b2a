import hashlib
from collections import defaultdict

import pytest

from offerrank.llm import digests

SCHEMA = "doc_id long, text string, digest int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA).repartition(3)


def brute(rows):
    """Sorted results of one load."""
    groups, out = defaultdict(list), []
    for i, t in rows:
        groups[t or ""].append(i)
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, seen = max(known, default=None), False
        for i in ids:
            out.append((i, hashlib.sha256(t.encode()).hexdigest(), keep, len(ids), i == keep and not seen))
            seen |= i == keep
    return sorted(out, key=str)


def result(df):
    return sorted(((r.id, bytes(r.digest).hex(), r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


ODD = [(1, "a"), (2, None), (3, ""), (4, "a"), (None, "a"), (4, "a"), (None, "only null"), (None, "only null"), (-5, "Ä" * 300_000), (6, "Ä" * 300_000), (7, " a"), (8, "A")]


def test_odd_rows(spark, tmp_path):
    index = digests.DigestIndex.create(spark, str(tmp_path / "i"), 10)
    assert result(digests.deduplicate(frame(spark, ODD), index, "one")) == brute(ODD)


def test_empty_table(spark, tmp_path):
    index = digests.DigestIndex.create(spark, str(tmp_path / "i"), 0)
    assert digests.deduplicate(frame(spark, []), index, "one").collect() == []
    assert index.totals().collect() == []


def test_loads_repeat_and_compaction(spark, tmp_path):
    """Later loads meet what earlier ones left; a repeated load changes nothing; a new session opens the same files."""
    index = digests.DigestIndex.create(spark, str(tmp_path / "i"), 100)
    one = [(k, f"t{k % 40}") for k in range(60)]
    two = [(100 + k, f"t{k}") for k in range(30, 70)]
    digests.deduplicate(frame(spark, one), index, "one").collect()
    for _ in range(2):  # the second time replaces the part
        got = {r.id: (r.keep_id, r.group_size, r.kept) for r in digests.deduplicate(frame(spark, two), index, "two").collect()}
    sizes = defaultdict(int)
    for _, t in one + two:
        sizes[t] += 1
    first = {t: i for i, t in one}
    assert got == {i: (first.get(t, i), sizes[t], t not in first) for i, t in two}
    before = sorted((bytes(r.digest), r.keep_id, r.n) for r in index.totals().collect())
    index.compact()
    again = digests.DigestIndex(spark.newSession(), str(tmp_path / "i"))
    assert sorted((bytes(r.digest), r.keep_id, r.n) for r in again.totals().collect()) == before
    assert again.entries().select("part").distinct().count() == 1
    more = digests.deduplicate(frame(spark, [(900, "t1"), (901, "new")]), digests.DigestIndex(spark, str(tmp_path / "i")), "three")
    assert {(r.id, r.keep_id, r.kept) for r in more.collect()} == {(900, 41, False), (901, 901, True)}


def test_a_crash_before_the_pointer_moves_leaves_the_old_index(spark, tmp_path, monkeypatch):
    index = digests.DigestIndex.create(spark, str(tmp_path / "i"), 10)
    digests.deduplicate(frame(spark, ODD), index, "one").collect()
    before = sorted(map(str, index.totals().collect()))
    monkeypatch.setattr(index, "_become", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.compact()
    assert sorted(map(str, digests.DigestIndex(spark, str(tmp_path / "i")).totals().collect())) == before


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = digests.DigestIndex.create(spark, str(tmp_path / "i"), 10)
    digests.deduplicate(frame(spark, ODD), index, "one").collect()
    groups = spark.createDataFrame([(b"x", 1, 1)], "digest binary, keep_id long, n long").repartition(digests.LEAST_BUCKETS, "digest")
    plan = index.fresh(groups, "two")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    side = plan[plan.index("Filter", plan.index("SortMergeJoin")):] if "Filter" in plan else plan
    assert plan.count("Exchange") == 1 and "Bucketed: true" in side
    assert "Exchange" not in index.totals()._jdf.queryExecution().executedPlan().toString()


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.text_sha256, r.keep_id, r.group_size, r.kept) for r in digests.op11(spark, sf).collect()), key=str)
    assert got == brute(rows)
