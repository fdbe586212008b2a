"""Joint boosting: against a plain leaf-wise trainer, and the same on any layout of the rows."""

import numpy as np
import pytest

from offerrank.operators import boosting
from offerrank.operators.boosting import LEAST_ROWS, UNIT, Boosted

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 700
    x = np.c_[rng.normal(size=n), rng.integers(0, 3, n), np.exp(rng.normal(size=n)), np.full(n, 2.0)]
    y = np.c_[3 * (x[:, 0] > 0.2) + x[:, 1] * (x[:, 2] > 1), x[:, 0] * x[:, 1] + rng.normal(size=n) / 10]
    rows = [(f"m{k}", *map(float, x[k]), *map(float, y[k]), float(1 + k % 3)) for k in range(n)]
    rows[7] = (rows[7][0], None, *rows[7][2:])
    rows[8] = (rows[8][0], float("nan"), *rows[8][2:])
    return spark.createDataFrame(rows, "member_id string, a double, b double, c double, d double, y0 double, y1 double, w double")


def train(df, **settings):
    given = {"rounds": 4, "leaves": 9, "rate": 0.3, "row_share": 1.0, "feature_share": 1.0, "seed": 3, "key": "member_id"} | settings
    return boosting.fit(df, FEATURES, ["y0", "y1"], **given)


def brute(rows, edges, mean, rounds, leaves, rate):
    """One target, all rows and features: the leaf of the largest gain is split until there are ``leaves``."""
    x = np.array([[np.nan if v is None else v for v in r[1:5]] for r in rows], float)
    y, w = np.array([r[5] for r in rows]), np.array([r[7] for r in rows])
    pred, trees = np.full(len(y), mean), []
    for _ in range(rounds):
        q = np.rint((y - pred) * UNIT)
        parts, made = [np.ones(len(y), bool)], []

        def best(part):
            found = (0.0,)
            for f, cuts in enumerate(edges):
                for c in cuts:
                    left = part & (x[:, f] <= c)
                    right = part & ~left
                    hl, hr = w[left].sum(), w[right].sum()
                    if hl >= LEAST_ROWS and hr >= LEAST_ROWS:
                        gl, gr = (q[left] * w[left]).sum(), (q[right] * w[right]).sum()
                        gain = (gl * gl / hl + gr * gr / hr - (gl + gr) ** 2 / (hl + hr)) / UNIT ** 2
                        if gain > found[0] + 1e-9:
                            found = gain, f, c, left, right
            return found
        options = [best(parts[0])]
        while len(parts) < leaves and max(o[0] for o in options) > 1e-9:
            at = int(np.argmax([o[0] for o in options]))
            _, f, c, left, right = options[at]
            made.append((f, c))
            parts[at:at + 1], options[at:at + 1] = [left, right], [best(left), best(right)]
        for part in parts:
            pred[part] += rate * (q[part] * w[part]).sum() / w[part].sum() / UNIT
        trees.append(sorted(made))
    return trees, pred


@pytest.mark.parametrize("rows_in_task", [0, 300, 1 << 16])
def test_equals_a_plain_leaf_wise_trainer(data, rows_in_task):
    model = train(data, weight="w", rows_in_task=rows_in_task)
    rows = sorted(map(tuple, data.collect()))
    trees, pred = brute(rows, model.edges, model.means[0], 4, 9, 0.3)
    have = [sorted((f, model.edges[f][t.arrays()[1][i]]) for i, f in enumerate(t.arrays()[0]) if f >= 0) for t in (r[0] for r in model.trees)]
    assert have == trees
    x = np.array([[np.nan if v is None else v for v in r[1:5]] for r in rows], float)
    bins = np.stack([np.where(np.isnan(x[:, k]), len(e), np.searchsorted(e, x[:, k])) for k, e in enumerate(model.edges)], 1)
    got = model.means[0] + sum(0.3 * r[0].value[boosting.leaf_of(bins, *r[0].arrays())] for r in model.trees)
    assert np.allclose(got, pred, atol=1e-9)


def test_the_same_on_any_layout(data, monkeypatch):
    """Tasks, partitions, where residuals are written, and where subtrees are grown make no difference."""
    settings = {"rounds": 7, "row_share": 0.8, "feature_share": 0.75}
    first = list(train(data.repartition(1), **settings).nodes())
    monkeypatch.setattr(boosting, "FEW_ROWS", 64)
    monkeypatch.setattr(boosting, "ROUNDS_PER_WRITE", 3)
    assert list(train(data.repartition(7), **settings).nodes()) == first
    assert list(train(data.repartition(4), rows_in_task=0, **settings).nodes()) == first
    assert list(train(data, rows_in_task=100, **settings).nodes()) == first


def test_joint_histograms_are_those_of_single_features():
    """Few and many bins, rows of several slots, weights or none, sums too large for one number: all by the same count."""
    rng, sizes = np.random.default_rng(2), [64, 2, 5, 1, 30, 2, 64, 3, 14]
    of = boosting.Histograms([np.arange(n - 1.0) for n in sizes])
    assert sum(map(len, of.groups)) == len(sizes) and len(of.groups) < len(sizes)
    n = 4 * boosting.ROWS_FOR_JOINT
    columns = np.stack([rng.integers(0, k, n) for k in sizes]).astype(np.uint8)
    slot, mask, at = rng.integers(0, 2, n), np.arange(len(sizes)), np.flatnonzero(rng.random(n) < 0.9)
    for size, w in ((1 << 20, None), (1 << 42, None), (1 << 20, rng.integers(1, 4, n).astype(float))):
        q = rng.integers(-size, size, n).astype(float)
        sums = of.of(columns, of.codes(columns), at, q[at], None if w is None else w[at], mask, slot[at], 2)
        for f, start in enumerate(of.starts):
            for s in range(2):
                own = at[slot[at] == s]
                for j, v in enumerate((q, np.ones(n) if w is None else w)):
                    assert sums[j, s, start:start + sizes[f]].tolist() == np.bincount(columns[f, own], v[own], sizes[f]).tolist()


def test_leaves_by_columns_are_those_by_rows(data):
    tree = train(data, rounds=1, leaves=12).trees[0][0].arrays()
    bins = np.random.default_rng(4).integers(0, 64, (500, len(FEATURES))).astype(np.uint8)
    assert boosting.leaf_of_columns(np.ascontiguousarray(bins.T), *tree).tolist() == boosting.leaf_of(bins, *tree).tolist()


def test_trees_are_not_applied_again_for_each_look(spark, data, monkeypatch):
    """Nodes are looked at several times a round; a tree is applied to the residuals once."""
    plans = []
    kept = type(data).persist
    monkeypatch.setattr(type(data), "persist", lambda df, *a: plans.append(df) or kept(df, *a))
    train(data, rounds=5, rows_in_task=0)
    assert len(plans) == 4 and not any(df.is_cached for df in plans)


def test_limits(spark, data):
    deep = train(data, depth=2, leaves=31)
    assert all(t.arrays()[4] <= 2 and len(t.way) <= 7 for r in deep.trees for t in r)
    assert all(h >= LEAST_ROWS for r in train(data).trees for t in r for _, h in t.sums)
    few = train(data.limit(LEAST_ROWS))
    assert all(len(t.way) == 1 for r in few.trees for t in r)
    none = train(data.limit(0), rounds=1)
    assert none.means == [0.0, 0.0] and isinstance(none, Boosted)


def test_binning(spark):
    df = spark.createDataFrame([(float(k % 5), float(k), 1.0, None) for k in range(1000)], "a double, b double, c double, d double")
    edges = boosting.feature_edges(df, FEATURES)
    assert edges[0].tolist() == [0.0, 1.0, 2.0, 3.0] and len(edges[1]) == boosting.BINS - 1 and len(edges[2]) == len(edges[3]) == 0
    assert np.allclose(edges[1], np.quantile(np.arange(1000), np.arange(1, 64) / 64))


def test_targets_in_tasks_of_their_own_make_the_same_trees(data, monkeypatch):
    """As by jobs for every round, on several blocks and with a sample of rows and features."""
    settings = {"rounds": 7, "row_share": 0.8, "feature_share": 0.75, "weight": "w"}
    monkeypatch.setattr(boosting, "ROWS_PER_BLOCK", 50)
    whole = train(data.repartition(3), **settings)
    monkeypatch.setattr(boosting, "ROWS_WHOLE", 0)
    for rows_in_task in (None, 100):
        apart = train(data.repartition(3), rows_in_task=rows_in_task, **settings)
        assert list(apart.nodes()) == list(whole.nodes())


def test_jobs_do_not_grow_with_rounds(spark, data):
    def jobs(rounds):
        spark.sparkContext.setJobGroup(f"rounds-{rounds}", "")
        train(data, rounds=rounds)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{rounds}"))
    few, many = jobs(2), jobs(9)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert few == many


def test_rows_are_dealt_to_a_task_for_each_target(spark):
    keys = boosting.key_of_each_part(spark, 16)
    dealt = spark.createDataFrame([(k,) for k in keys], "key long").repartition(16, "key")
    assert dealt.selectExpr("spark_partition_id() p").distinct().count() == 16


@pytest.mark.parametrize("sizes", [[64, 2, 3, 64, 7], [64, 64, 63], [5, 8, 8, 1, 9]])
def test_sums_of_many_rows_on_squares(sizes):
    rng = np.random.default_rng(2)
    columns = np.stack([rng.integers(0, n, 3000) for n in sizes]).astype(np.uint8)
    bins = boosting.Histograms([np.arange(n - 1.0) for n in sizes])
    codes, mask, q, slot = bins.codes(columns), np.arange(len(sizes)), rng.integers(-9**9, 9**9, 3000).astype(float), rng.integers(0, 2, 3000)
    assert len(codes) <= -(-len(sizes) // 2) and codes.itemsize == 2  # before: a code of 8 bytes for each group
    for rows, w in ((None, None), (np.arange(0, 3000, 2), None), (np.arange(0, 3000, 2), np.ones(1500) * 3)):
        at = np.arange(3000) if rows is None else rows
        want = np.zeros((2, 2, bins.width))
        for f, start in enumerate(bins.starts):
            np.add.at(want[0], (slot[at], start + columns[f, at]), q[at])
            np.add.at(want[1], (slot[at], start + columns[f, at]), 1.0 if w is None else w)
        assert np.array_equal(bins.of(columns, codes, rows, q[at], w, mask, slot[at], 2), want)


def test_a_tree_needs_only_the_joint_bins_of_its_rows():
    """A target's task holds no column of bins: 2 bytes for each square and row, and places of the sampled rows."""
    rng, sizes = np.random.default_rng(6), [64, 2, 5, 1, 30, 2, 64, 3, 14]
    bins = boosting.Histograms([np.arange(n - 1.0) for n in sizes])
    n = 2 * boosting.ROWS_PER_SUM + 500
    columns = np.stack([rng.integers(0, k, n) for k in sizes]).astype(np.uint8)
    codes, mask, keep = bins.codes(columns), np.array([0, 1, 2, 4, 6, 7, 8]), np.flatnonzero(rng.random(n) < 0.8)
    assert codes.nbytes < columns.nbytes
    q = np.rint((3.0 * (columns[0] > 20) + columns[2] * (columns[6] > 9) + rng.normal(size=n)) * UNIT)
    for w in (np.ones(n), rng.integers(1, 4, n).astype(float)):
        want = bins.grow(columns[:, keep], q[keep] * w[keep], w[keep], mask, 30, None, "").final(30, None)
        have = bins.grow(None, q * w, w, mask, 30, None, "", codes, keep).final(30, None)
        assert have.sums == want.sums and all(np.array_equal(a, b) for a, b in zip(have.arrays(), want.arrays()))
        leaf = np.full(n, -1)
        for k, at in bins.leaves(codes, *have.arrays()[:4]):
            leaf[at] = k
        assert len(have.way) > 20 and leaf.tolist() == boosting.leaf_of_columns(columns, *have.arrays()).tolist()
