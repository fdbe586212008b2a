import hashlib
import re

import pytest

from offerrank.llm import spotsigs


def words(text):
    return re.sub("[^a-z0-9\x80-\U0010FFFF]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).strip(" ").split(" ")


def murmur(parts):
    """Spark's hash of strings one after the other."""
    def mix(h, k):
        k = k * 0xCC9E2D51 & M
        h ^= (k << 15 | k >> 17) * 0x1B873593 & M
        return ((h << 13 | h >> 19) & M) * 5 + 0xE6546B64 & M

    h, M = 42, 0xFFFFFFFF
    for p in parts:
        b = p.encode()
        cut = len(b) // 4 * 4
        for k in range(0, cut, 4):
            h = mix(h, int.from_bytes(b[k:k + 4], "little"))
        for c in b[cut:]:
            h = mix(h, (c - 256 if c > 127 else c) & M)
        h ^= len(b)
        h = (h ^ h >> 16) * 0x85EBCA6B & M
        h = (h ^ h >> 13) * 0xC2B2AE35 & M
        h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def least(parts, length, most):
    return sorted({murmur(parts[k:k + length]) for k in range(len(parts) - length + 1)})[:most]


def chains(text):
    w = words(text)
    out = set()
    for k, x in enumerate(w):
        ahead = [y for y in w[k + 1:k + 9] if y not in spotsigs.STOP][:2]
        if x in spotsigs.ANCHORS and len(ahead) == 2:
            out.add(murmur([x, *ahead]))
    few = len(out) < spotsigs.FEW
    out.update(least(w, 2, spotsigs.SPARE if few else spotsigs.ALWAYS))
    if few and len(w) < spotsigs.SHORT:
        out.update(least(list(" ".join(w)), 4, spotsigs.SPARE))
    return out or {murmur(w)}


def printed(sigs):
    return "".join(f"{s & 0xFFFFFFFF:08x}" for s in sorted(sigs))


def likeness(a, b):
    return len(a & b) / len(a | b)


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), likeness(chains(t), chains(edited)), likeness(chains(t), chains(after)),
                    printed(chains(t)), printed(chains(edited))))
    return sorted(out, key=str)


def shown(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.fingerprint, r.edited_fingerprint)
                   for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert shown(spotsigs.op8(spark, sf)) == brute(rows)


def test_edges(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "The cat was on a mat that day."), (3, "The cat was on a mat that day."), (3, "Ä 𝄞 the é ö ü"), (9, "the is was " * 40_000 + "x y"),
            (None, "that one thing"), (None, "the end of it all"), (-5, "x")]
    path = str(tmp_path / "t")
    spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, block int, next_text string").repartition(4).write.parquet(f"{path}/documents.parquet")
    assert shown(spotsigs.op8(spark, path)) == brute(rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert spotsigs.fingerprints(docs.limit(0)).count() == 0
    assert spotsigs.fingerprints(docs.filter("doc_id = 9")).count() == 1


ITALIAN = "Nel mezzo della nostra strada abbiamo trovato un bosco molto scuro, perché il sentiero giusto era andato perduto ieri sera"
JAPANESE = "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所でニャーニャー泣いていた事だけは記憶している。"


def test_texts_without_anchors(spark, tmp_path):
    """Half of a text is kept, so its fingerprint stays near, in any language and at any length; other texts stay far."""
    texts = [ITALIAN, JAPANESE, "Wczoraj wieczorem poszliśmy razem nad rzekę, ale mgła była tak gęsta, że nikt nie widział drugiego brzegu",
             "alpha beta gamma delta", "x = 17; y[3] += 4; call(foo, bar); return z", "singleword", "𝄞𝄢𝄫𝄪♯♭♮𝄐𝄑𝄒"]
    path = str(tmp_path / "t")
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    got = spotsigs.op8(spark, path).orderBy("doc_id").collect()
    assert shown(spotsigs.op8(spark, path)) == brute(rows)
    assert all(r.near_edited > 0.1 for r in got) and all(r.near_next == 0 for r in got)


def test_half_kept_is_near(spark):
    """On a whole table a text of 20 characters or more is at 0 from its edited form only where that keeps few different chains."""
    sf = "/root/testdata/sf0.01"
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in spotsigs.op8(spark, sf).select("doc_id", "near_edited", "near_next", "n_chars").collect()}
    zero = []
    for k, (i, t) in enumerate(texts):
        if len(t) >= 20 and got[i].near_edited == 0:
            edited = t[:len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][1][:len(t) // 2]
            a, b = ({tuple(x) for x in zip(w, w[1:])} for w in (words(t), words(edited)))
            zero.append(len(a & b) / len(a | b))
    assert len(zero) <= 10 and all(share < 0.2 for share in zero)
    assert sum(r.near_edited > r.near_next for r in got.values()) >= 0.98 * len(got)


def test_many_blocks(spark, sf, monkeypatch):
    monkeypatch.setattr(spotsigs, "BLOCK", 3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert shown(spotsigs.op8(spark, sf)) == brute(rows)


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_near_pairs(spark, sf, least):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "the same words the other thing")], "doc_id long, text string"))
    sets = {r.doc_id: frozenset(chains(r.text)) for r in docs.collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    pairs, members = spotsigs.near_pairs(docs, least)
    assert {(r.id, r.class_id) for r in members.collect()} == {(i, first[s]) for i, s in sets.items()}
    reps = sorted((i, s) for s, i in first.items())
    want = {(a, b) for k, (a, s) in enumerate(reps) for b, t in reps[k + 1:] if likeness(s, t) >= least}
    assert {(r.a, r.b) for r in pairs.collect()} == want


def test_no_python(spark, sf):
    plan = spotsigs.op8(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
