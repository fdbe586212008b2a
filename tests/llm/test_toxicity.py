import re
import zlib

import numpy as np
import pytest

from offerrank.llm import toxicity


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


def test_words_and_stems():
    one = toxicity.word_rows("Idiot, idiots! IDIOT ÉTÉ été étés")
    assert len(one) == 6 and (one[0] == one[2]).all() and (one[3] == one[4]).all()
    assert one[0, 0] != one[1, 0] and one[0, 1] == one[1, 1] and (one > 0).all()
    assert toxicity.word_rows(None).shape == toxicity.word_rows(" .,").shape == (0, 3)


def test_long_texts_in_portions(monkeypatch):
    text = "Wörter und, noch mehr Wörter … " * 40
    whole = toxicity.word_rows(text)
    model = toxicity.train([whole, whole[:3]], [1, 0], epochs=1)
    score = model.score(whole)
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    monkeypatch.setattr(toxicity, "PORTION", 5)
    assert (toxicity.word_rows(text) == whole).all()
    assert model.score(whole) == pytest.approx(score, abs=1e-6)
    assert model.score(whole[:0]) == pytest.approx(model.score(toxicity.word_rows("")))


def test_held_out_accuracy_and_no_leak(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in toxic if fold(i) == 2]
    assert all(got[i].held_out == (fold(i) == 2) for i in got)
    score = np.array([got[i].score for i in held])
    mark = np.array([toxic[i] for i in held])
    auc = (score[mark == 1][:, None] > score[mark == 0]).mean()
    assert auc > 0.9
    # swapped labels of held-out rows, other languages and sources change no score
    from pyspark.sql import functions as F
    swapped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = {r.id: r.score for r in toxicity.classify(docs.withColumn("lang", F.lit("xx")).repartition(3), swapped).collect()}
    assert other == {i: r.score for i, r in got.items()}


def test_thresholds_by_language(spark):
    ids = [i for i in range(4000) if fold(i) != 2 and zlib.crc32(str(i).encode()) // 4 % 8 == 0][:200]
    scored = spark.createDataFrame([(i, "a" if k % 2 else "b", (0.9 if k % 4 < 2 else 0.2) * (0.5 if k % 2 else 1.0)) for k, i in enumerate(ids)],
                                   "id long, lang string, score double")
    labels = spark.createDataFrame([(i, int(k % 4 < 2)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    got = {r.lang: r.threshold for r in toxicity.thresholds(scored, labels).collect()}
    assert 0.1 < got["a"] <= 0.45 and 0.2 < got["b"] <= 0.9 and None in got


def test_edges(spark):
    rows = [(1, None, "en", 3), (2, "", None, 3), (None, "x", "de", 3), (4, "w " * 200_000, "en", 3), (4, "w", "en", 3), (4, "w", "en", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(1, 0), (1, None), (9, 1)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.classify(docs.limit(0), labels.limit(0)).count() == 0


def test_tokens_of_words():
    assert len(toxicity.word_rows("a-b_c d")) == len(re.findall("[a-z]", "a-b_c d"))


def test_scores_do_not_follow_the_sample(spark, monkeypatch):
    """A sample with as many toxic as clean rows scores the held-out texts like all rows, one in nine of which is toxic."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(toxicity, "UPDATES", 12_000)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    held = [toxicity.word_rows(r.text) for r in docs.filter(toxicity.held_out(F.col("doc_id"))).orderBy("doc_id").limit(600).collect()]
    shares = []
    for most in (3000, 290):
        model = toxicity.fit(docs, labels, max_rows=most)
        shares.append(np.mean([model.score(w) >= 0.3 for w in held]))
    assert abs(shares[0] - shares[1]) < 0.025


def test_bytes_on_the_driver_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, marks: seen.append((texts, marks)) or toxicity.Model(None, [], None, None, 0.0))
    ids = [i for i in range(200) if fold(i) != 2 and zlib.crc32(str(i).encode()) // 4 % 8][:60]
    docs = spark.createDataFrame([(i, "word " * (50_000 if k % 5 == 0 else 20)) for k, i in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k % 3 == 0)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, max_bytes=100_000)
    (texts, marks), = seen
    assert sum(t.nbytes for t in texts) <= 100_000 and 0 < sum(marks) < len(marks) == 48
    assert model.out_bias == pytest.approx(np.log(20 / 40) - np.log(16 / 32))


def test_updates_are_fixed(monkeypatch):
    monkeypatch.setattr(toxicity, "UPDATES", 25)
    turns, make = [], np.random.default_rng

    class Generator:
        def __init__(self, seed):
            self.of = make(seed)

        def permutation(self, n):
            turns.append(n)
            return self.of.permutation(n)

        def __getattr__(self, name):
            return getattr(self.of, name)
    monkeypatch.setattr(np.random, "default_rng", Generator)
    for n in (2, 10):
        turns.clear()
        toxicity.train([toxicity.word_rows(f"word{k} x") for k in range(n)], [k % 2 for k in range(n)])
        assert len(turns) == -(-25 // n)


def plain_score(model, rows):
    """The network by single windows, filters and words, in doubles."""
    widest = len(model.filters)
    rows = [list(r) for r in toxicity.padded(rows)]
    z = float(model.out_bias)
    x = [[sum(float(model.emb[r, d]) for r in word) for d in range(toxicity.DIM)] for word in rows]
    for k in range(widest):
        for f in range(toxicity.FILTERS):
            best = max(sum(sum(a * float(w) for a, w in zip(x[at + j], model.filters[k][j, :, f])) for j in range(k + 1))
                       for at in range(len(x) - widest + 1))
            z += max(best + float(model.bias[k, f]), 0) * float(model.out[k, f])
    return 1 / (1 + np.exp(-min(max(z, -30), 30)))


def test_scores_by_a_plain_forward_pass(spark, sf):
    """All texts of a table are scored; the shorter ones, 6,000 words together, are compared with plain loops."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.union(spark.createDataFrame([(10_000, None, None), (10_001, "", "xx"), (10_002, "one", "en")], docs.schema))
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = {r.doc_id: toxicity.word_rows(r.text) for r in docs.collect()}
    ids = [i for i in sorted(marks) if i in rows and fold(i) != 2]
    model = toxicity.train([rows[i] for i in ids], [int(marks[i]) for i in ids], epochs=1)
    got = {r.id: r.score for r in toxicity.scores(docs, model).collect()}
    assert set(got) == set(rows)
    short = sorted(rows, key=lambda i: len(rows[i]))
    taken, total = [], 0
    for i in short:
        total += len(rows[i])
        if total > 6_000:
            break
        taken.append(i)
    assert len(taken) > 20
    assert all(got[i] == pytest.approx(plain_score(model, rows[i]), abs=2e-4) for i in taken)
