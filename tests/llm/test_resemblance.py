from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from offerrank.llm import resemblance, simhash


def chains(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """The smallest id of each row's component, by all pairs of different texts that share a chain."""
    sets = sorted({chains(t) for _, t in rows}, key=sorted)
    root, having = list(range(len(sets))), defaultdict(list)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k
    for k, s in enumerate(sets):
        shared = defaultdict(int)
        for c in s:
            for j in having[c]:
                shared[j] += 1
            having[c].append(k)
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                root[max(top(j), top(k))] = min(top(j), top(k))
    place, least = {s: k for k, s in enumerate(sets)}, {}
    for i, t in rows:
        r = top(place[chains(t)])
        least[r] = min(i, least.get(r, i))
    return sorted((i, least[top(place[chains(t)])]) for i, t in rows)


@pytest.mark.parametrize("edits", [1, 4])
def test_stage_against_brute_force(spark, tmp_path, edits):
    """Copies with a few changed words, in groups small and large, and chains of them."""
    rng = np.random.default_rng(edits)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows += [(100_000, None), (100_001, ""), (100_002, "two words"), (100_003, "Two  WORDS")]
    for g in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        for k in range(60 if g == 0 else 6):
            words = list(words) if g % 2 else words
            new = list(words)
            for at in rng.choice(150, edits, replace=False):
                new[at] = f"x{rng.integers(1 << 40)}"
            rows.append((200_000 + 1000 * g + k, " ".join(new)))
            words = new if g % 2 else words
    want = brute(rows)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = resemblance.near_duplicates(docs)
    assert sorted((r.id, r.component) for r in got.collect()) == want
    kept = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want})


def test_a_torn_bucket_gives_few_rows(spark):
    """A hot group whose members are alike only along a chain: dealt in parts, it gives the same components."""
    rng, rows = np.random.default_rng(8), []
    words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    for k in range(300):
        words = list(words)
        words[int(rng.integers(200))] = f"x{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    for tile in (resemblance.TILE, 32):
        assert sorted((r.id, r.component) for r in resemblance.near_duplicates(docs, tile=tile).collect()) == want


def test_links_of_a_group_are_fewer_than_its_rows():
    import pyarrow as pa
    rng, sets = np.random.default_rng(3), []
    base = np.unique(rng.integers(0, 1 << 60, 400).astype(np.uint64))
    for _ in range(200):
        sets.append(np.unique(np.r_[base[rng.random(len(base)) < 0.97], rng.integers(0, 1 << 60, 4).astype(np.uint64)]))
    sketches = [(resemblance.min_hashes(x) >> np.uint64(32)).astype(np.uint32).tobytes() for x in sets]
    n = len(sets)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * n), pa.array([0] * n, pa.int32()), pa.array(range(n)), pa.array(range(n)), pa.array([0] * n, pa.int32()), pa.array([len(x) for x in sets]),
         pa.array(sketches, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["key", "place", "node", "label", "part", "n", "sketch", "hashes"])
    met = list(resemblance.meeting_batches(iter([batch])))
    assert sum(b.num_rows for b in met) <= n
    links = list(resemblance.joining_batches(iter([batch])))
    assert sum(b.num_rows for b in links) < n and sum(b.num_rows for b in links) > n // 2


def as_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_different_texts_of_one_id_are_documents_of_their_own(spark, tmp_path):
    one, two, three = (" ".join(f"{name}{k}" for k in range(60)) for name in "abc")
    docs = as_docs(spark, [(5, two), (5, one), (5, one), (3, one), (5, three), (9, two + " more")])
    kept = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, one), (5, two), (5, three)]


def test_texts_of_one_fingerprint_are_all_compared(spark, tmp_path, monkeypatch):
    """Not only with the smallest id among them, which is unlike the others here."""
    import pyarrow as pa
    common = "one two three four five " * 400
    a, b = (" ".join(f"{name}{k}" for k in range(40)) for name in "ab")
    rows = [(1, common + a), *((k, common + b + " more" * (k - 2)) for k in range(2, 5))]
    assert len({simhash.fingerprint(t) for _, t in rows}) == 1

    def no_bands(batches):
        for batch in batches:  # no two rows share a key
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(0), pa.array([0] * batch.num_rows, pa.int32())], ["key", "node", "band"])
    monkeypatch.setattr(resemblance, "band_batches", no_bands)
    kept = corpus_pipeline.one_of_each_group(spark, as_docs(spark, rows), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, " "), (None, "only null here"), (None, "only null here"), (5, "one two three four five six"), (5, "one two three four five six"),
            (6, "One two  three four five six"), (7, "Ä " * 40_000), (8, "Ä " * 39_999 + "Ö")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, node int").repartition(3)
    got = sorted(((r.id, r.component) for r in resemblance.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, 1), (None, None), (None, None), (5, 5), (5, 5), (6, 5), (7, 7), (8, 8)], key=str)


def test_empty(spark):
    assert resemblance.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
