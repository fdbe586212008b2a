import numpy as np
import pytest
import xxhash

from offerrank.llm import simhash


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, f"{f:016x}", least.get(root(k))) for k, (i, f) in enumerate(fps)), key=str)


def test_golay_is_perfect():
    rest, error = simhash.golay()
    assert len(set(error.tolist())) == 2048 and max(int(e).bit_count() for e in error) == 3


@pytest.mark.parametrize("flips", [0, 1, 2, 3, 4])
def test_up_to_four_bits_share_a_key(flips):
    rng = np.random.default_rng(flips)
    a = rng.integers(-2**63, 2**63, 400)
    b = a.copy()
    for row in range(len(b)):
        for bit in rng.choice(64, flips, replace=False):
            b[row] ^= np.int64(np.uint64(1) << np.uint64(bit))
    keys = [[set() for _ in a] for _ in range(2)]
    for side, v in enumerate((a, b)):
        k, r = simhash.keys_of(v)
        for key, row in zip(k.tolist(), r.tolist()):
            keys[side][row].add(key)
    assert all(x & y for x, y in zip(*keys))


def test_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in simhash.op5(spark, sf).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == brute_components(rows)


def test_edge_cases(spark):
    long = "word " * 70000
    rows = [(1, None, 5, "x"), (2, "", 5, "x"), (3, " \t", 5, "x"), (4, long, 6, "y"), (4, long, 6, "y"), (None, "a b c", 7, "z"),
            (6, "A B C", 7, "z"), (7, "ÄÖ ß", 7, None), (8, "a b c d e f g", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component string")
    got = simhash.near_duplicates(docs)
    out = sorted(((r.id, f"{r.fp & (2**64 - 1):016x}", r.component) for r in got.collect()), key=str)
    assert out == brute_components([r[:2] for r in rows])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [(63,), (0, 63), (5, 20, 41, 63)])
def test_links_across_the_sign(spark, bits):
    a = 0x0123456789ABCDEF
    b = a ^ sum(1 << k for k in bits)
    got = simhash.links(spark.createDataFrame([(a,), (b - (1 << 64),)], "fp long")).collect()
    assert [{r.a, r.b} for r in got] == [{a, b - (1 << 64)}]


def test_dense_bucket_keeps_its_links():
    rng = np.random.default_rng(1)
    base = np.uint64(rng.integers(2**62, 2**63))
    one = np.uint64(1)
    fp = np.unique(np.array([base ^ one << a ^ one << b for a, b in rng.integers(0, 64, (300, 2), dtype=np.uint64)])).view(np.int64)
    pairs = list(simhash.spanning(fp, 4))
    assert sum(len(a) for a, _ in pairs) == len(fp) - 1
