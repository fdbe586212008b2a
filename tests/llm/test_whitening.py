import math
from fractions import Fraction

import numpy as np
import pytest

from offerrank.llm import whitening
from offerrank.llm.whitening import Spectrum, rank_one


def brute(rows, components=4):
    """Per length: n, exact deviations, and coordinates up to sign from a dense decomposition."""
    kept = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows
            if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for dim in {len(x) for _, x in kept}:
        fit = sorted({x for _, x in kept if len(x) == dim})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        mean = np.array([float(Fraction(s, n)) for s in sums])
        y = np.array(fit, float) - mean
        values, axes = np.linalg.eigh(y.T @ y / n)
        values, axes = values[::-1], axes[:, ::-1]
        k = min(components, int((values > dim * 1e-15 * 4 * max(values[0], 0)).sum()))
        for i, x in kept:
            if len(x) == dim:
                w = (np.array(x, float) - mean) @ axes[:, :k] / np.sqrt(values[:k])
                d = sum((n * c - s) ** 2 for c, s in zip(x, sums))
                out.extend((i, c + 1, n, d, w[c], values[c] / values.sum()) for c in range(k))
    return out


def compare(got, want):
    def key(r):
        return str(r[0]), r[1], r[2], r[3], round(abs(r[4]), 6)
    got, want = sorted(((r[0], r.component, r.n, r.deviation, r.whitened, r.explained) for r in got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([abs(r[4]) for r in got], [abs(r[4]) for r in want], rtol=1e-8, atol=1e-9)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-10)
    return got


def frame(spark, rows, kind="float", parts=5):
    return spark.createDataFrame([(i, v, 3, "s") for i, v in rows], f"vec_id long, embedding array<{kind}>, n int, part string").repartition(parts)


@pytest.mark.parametrize("dim,n,flat", [(1, 6, 0), (2, 40, 0), (24, 300, 0), (24, 10, 0), (16, 200, 1)])
def test_rank_one_updates_give_the_scatter(dim, n, flat):
    rng = np.random.default_rng(dim + n)
    x = np.floor(rng.normal(size=(n, dim)) * 90 * np.exp(rng.normal(size=dim))).astype(np.int64)
    if flat:  # equal columns and a constant one: eigenvalues that repeat
        x[:, dim // 2:], x[:, 3] = x[:, :dim // 2], 5
    parts = [Spectrum.empty(dim) for _ in range(4)]
    for k, v in enumerate(x):
        parts[k * k % 4].add(v)
    whole = Spectrum.unpack(parts[0].pack(), dim)
    for p in parts[1:]:
        if p.n:
            whole.join(p)
    y = x - x.mean(0)
    scatter = y.T @ y
    values = np.linalg.eigvalsh(scatter)
    assert whole.n == n and whole.sums() == x.sum(0).tolist()
    assert np.abs(whole.d - values).max() <= 1e-13 * values.max()
    assert np.abs(whole.u * whole.d @ whole.u.T - scatter).max() <= 1e-13 * values.max()
    assert np.abs(whole.u.T @ whole.u - np.eye(dim)).max() <= 1e-12


def test_deflation():
    u, d = np.eye(4), np.array([1.0, 1.0, 1.0, 5.0])
    for v in (np.array([0, 0, 0, 1.0]), np.ones(4), np.array([1e-20, 1, 0, 1e-9]), np.zeros(4)):
        e, w = rank_one(d, u, v, 2.0)
        assert np.allclose(w * e @ w.T, np.diag(d) + 2 * np.outer(v, v), atol=1e-14) and np.allclose(w.T @ w, np.eye(4), atol=1e-14)
        assert (np.diff(e) >= 0).all()


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=6).astype(np.float32).tolist()) for k in range(50)]
    rows += [(90, rows[3][1]), (90, rows[3][1]), (None, rows[4][1]), (91, None), (92, [float("nan")] * 6), (93, [None] + [0.0] * 5), (94, []),
             (95, [0.0] * 6), (96, [-0.0] * 6), (97, [float("inf")] * 6), (98, [1.0, 2.0]), (99, [1.5, 0.0]), (100, [0.25, 7.0])]
    got = compare(whitening.whiten(frame(spark, rows)).collect(), brute(rows))
    assert {r[0] for r in got} == {*range(50), 90, None, 95, 96, 98, 99, 100}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(frame(spark, rows)).collect() == []


def test_large_numbers_are_exact(spark):
    rows = [(k, [float((k * 7919 % 23) << s) for s in (0, 20, 26)]) for k in range(20)]
    want = {(i, d if d < 1 << 63 else None) for i, _, _, d, _, _ in brute(rows)}
    got = whitening.whiten(frame(spark, rows, "double")).collect()
    assert {(r.id, r.deviation) for r in got} == want


def test_many_tasks_and_a_very_common_vector(spark):
    """More spectra than meet in one task; copies count once."""
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=5) * [5, 3, 2, 1, 1]).tolist()) for k in range(400)] + [(1000 + k, [3.0, 0.0, 0.0, 0.0, 1.0]) for k in range(300)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = whitening.whiten(frame(spark, rows, "double", 40)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    compare(got, brute(rows))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-11


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = whitening.op13(spark, sf).collect()
    compare(got, brute(rows))
    assert {len(r) for r in got} == {7} and max(r.identity_error for r in got) < 1e-11
