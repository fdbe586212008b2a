import numpy as np
import pytest

from offerrank.llm import itq


def brute(rows, least=0.93):
    """Per row: the rows it links to, and components by row number."""
    good = []
    for _, v, label in rows:
        x = None if v is None or label is None or any(c is None for c in v) else np.array(v, np.float64)
        good.append(None if x is None or not len(x) or not np.isfinite(x).all() or not x.any() else x / np.linalg.norm(x))
    near = [set() for _ in rows]
    for i, x in enumerate(good):
        for j in range(i):
            y = good[j]
            if x is not None and y is not None and rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y >= least:
                near[i].add(j)
                near[j].add(i)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        root[i] = min(ids) if ids else None
    return near, root


def compare(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, cls int").repartition(5)
    got = itq.near_duplicates(df, **kw).collect()
    assert len(got) == len(rows)
    near, root = brute([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], k) for i, v, k in rows])
    have = {r.id: (r.n_links, r.component) for r in got if r.id is not None}
    want = {i: (len(n), c) for (i, _, _), n, c in zip(rows, near, root) if i is not None}
    return got, have, want


def test_recall_near_the_threshold(spark):
    """Every vector gets noisy twins whose cosines spread from 0.9 to 1."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label").limit(1000).collect()]
    rng = np.random.default_rng(4)
    for k, (_, v, label) in enumerate(rows[:600]):
        v = np.array(v)
        noise = rng.normal(size=len(v))
        noise *= np.linalg.norm(v) / np.linalg.norm(noise)
        rows.append((100_000 + k, (v + noise * rng.uniform(0.02, 0.48)).tolist(), label))
    _, have, want = compare(spark, rows)
    assert all(have[i][0] <= want[i][0] for i in want)
    links = sum(n for n, _ in want.values())
    assert links > 600 and sum(n for n, _ in have.values()) >= 0.95 * links


def clustered(n=400, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(k, (centres[k % 12] + rng.normal(0, 0.05, dim)).tolist(), k % 3) for k in range(n)]


@pytest.mark.parametrize("tile", [5, 2048])
def test_clusters_copies_and_tiles(spark, tile):
    rows = clustered()
    rows += [(1000 + k, rows[7][1], rows[7][2]) for k in range(50)]
    _, have, want = compare(spark, rows, tile=tile)
    assert have == want


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 2), (3, v, None), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 3.0], 1), (7, [float("nan"), 1.0, 1.0], 1),
            (8, [float("inf"), 1.0, 1.0], 1), (9, [], 1), (10, [2.0, 4.0, 6.0], 1), (11, v, 1), (11, v, 1), (None, v, 1), (12, [1.0, 2.0], 1), (13, [-0.0, 1e-30, 1.0], 1)]
    got, have, want = compare(spark, rows)
    assert have == want
    assert [(r.n_links, r.component) for r in got if r.id is None] == [(4, 1)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label string")
    assert itq.near_duplicates(empty).count() == 0


def test_rotation_is_orthogonal_and_balanced():
    x = np.random.default_rng(0).normal(size=(500, 16)) * np.linspace(1, 4, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for mean, turn in itq.learn(x):
        assert np.allclose(turn.T @ turn, np.eye(16), atol=1e-8)
        assert (abs(((x - mean) @ turn >= 0).mean(0) - 0.5) < 0.12).all()


def test_hot_bucket_is_never_gathered_whole(spark, monkeypatch):
    """Near copies that fill a bucket of many tiles: no group that a task holds is larger than a tile."""
    make, tile = itq.candidate_batches, 8

    def bounded(*args):
        work = make(*args)

        def checked(batches):
            def seen():
                key, n = None, 0
                for b in batches:
                    for k in b.column(0).to_pylist():
                        key, n = k, n + 1 if k == key else 1
                        assert n <= tile, "more than one tile"
                    yield b
            return work(seen())
        return checked
    monkeypatch.setattr(itq, "candidate_batches", bounded)
    rng = np.random.default_rng(8)
    base = rng.normal(size=24)
    rows = clustered(200) + [(5000 + k, (base + rng.normal(0, 0.002, 24)).tolist(), 0) for k in range(150)]
    _, have, want = compare(spark, rows, tile=tile)
    assert have == want
