import re
from collections import Counter, defaultdict

import pytest
from test_mixing import brute_targets
from test_packing import check
from test_resemblance import brute as brute_near
from test_suffixes import brute as brute_repeats

import corpus_pipeline
from offerrank.llm import packing, simhash, toxicity
from offerrank.llm.common import WORD

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        out.append(docs.collect())
    return out


def test_columns(stages):
    assert all(list(rows[0].asDict()) == corpus_pipeline.COLUMNS for rows in stages[:-1])


def test_toxicity(spark, stages):
    judged = toxicity.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    flagged = {r.id for r in judged if r.flagged}
    assert {r.doc_id for r in stages[1]} == {r.doc_id for r in stages[0]} - flagged
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1]}
    assert sum(i in kept for i, t in toxic.items() if t) < 0.3 * sum(toxic.values())
    assert sum(i not in kept for i, t in toxic.items() if not t) < 0.05 * sum(not t for t in toxic.values())


def test_near_duplicates(stages):
    want = {c for _, c in brute_near([(r.doc_id, r.text) for r in stages[1]])}
    rows = {r.doc_id: r for r in stages[1]}
    assert sorted(stages[2]) == sorted(rows[i] for i in want)


def test_pairs_of_close_fingerprints_are_checked_without_a_shared_band(spark, tmp_path, monkeypatch):
    """SimHash brings pairs to the exact check by itself; those below a likeness of 0.8 do not pass it."""
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    common = "one two three four five " * 60
    texts = {7: common + words("a", 12), 3: common + words("b", 12), 4: words("c", 400), 8: words("c", 400) + " more", 9: "ONE " + words("c", 400)}
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    pairs = {frozenset(r) for r in simhash.linked_ids(docs).collect()}
    assert {frozenset((3, 7)), frozenset((4, 8)), frozenset((4, 9))} <= pairs and all(a in texts for p in pairs for a in p)

    def no_bands(batches):
        import pyarrow as pa
        for b in batches:  # no two rows share a key
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(0), pa.array([0] * b.num_rows, pa.int32())], ["key", "node", "band"])
    monkeypatch.setattr(corpus_pipeline.resemblance, "band_batches", no_bands)
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()) == [3, 4, 7]


def test_repeats(stages):
    before = {r.doc_id: r for r in stages[2]}
    removed = {i: (n, gone) for i, n, gone, _, _ in brute_repeats([(r.doc_id, r.text) for r in stages[2]])}
    for r in stages[3]:
        n, gone = removed[r.doc_id]
        if gone:
            assert len(r.text.encode()) in range(n - gone - 6, n - gone + 1) and r.n_chars == len(r.text)
        else:
            assert r == before[r.doc_id]
    lost = set(before) - {r.doc_id for r in stages[3]}
    assert all(removed[i][0] - removed[i][1] < 60 for i in lost)


def test_mixing(stages):
    size = {r.doc_id: len(re.findall(WORD, r.text or "")) for r in stages[3]}
    source = {r.doc_id: r.source for r in stages[3]}
    total, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i in size:
        total[source[i]] += size[i]
        largest[source[i]] = max(largest[source[i]], size[i])
    for i, n in Counter(r.doc_id for r in stages[4]).items():
        assert n <= 3
        taken[source[i]] += n * size[i]
    for s, t in brute_targets(dict(total)).items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6
    assert set(stages[4]) <= set(stages[3])


def test_packing(stages):
    want, have = check([(r.doc_id, r.text) for r in stages[4]], stages_with_id(stages[5]), packing.CAPACITIES)
    assert want == have


def stages_with_id(rows):
    from collections import namedtuple
    Row = namedtuple("Row", ["id", *[c for c in rows[0].asDict() if c != "doc_id"]])
    return [Row(*r) for r in rows]


def test_run(spark, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, stages[5]))


def test_stages_stand_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y z " * 30, "en", None, 3), (None, "x y z " * 30, "en", None, 3), (5, "Ä " * 3000, None, "b", 1),
            (5, "Ä " * 3000, None, "b", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, docs.limit(0)):
        kept = start
        for name, stage in corpus_pipeline.STAGES:
            alone = stage(spark, start, str(tmp_path)).collect()
            kept = stage(spark, kept, str(tmp_path))
            assert name == "packing" or kept.columns == corpus_pipeline.COLUMNS
            if name == "simhash":
                assert len(alone) == (3 if start is docs else 0)
        assert start is docs or kept.count() == 0
