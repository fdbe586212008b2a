"""Shapley values of the tree models, path-dependent form (Lundberg et al. 2018).

A tree is a sum over its leaves. A leaf's share is its value times one factor
per feature on its path: 1 or 0 when the feature is known (its conditions hold
or not), the share of training rows that pass when it is unknown. The Shapley
value of such a product needs only the coefficients of a small polynomial.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from offerrank.functions.scalar import round_even
from offerrank.operators.learn import OfferModel
from offerrank.session import materialize

CELLS_PER_STEP = 1_000_000
ROWS_PER_STEP = 8_192  # few enough for a fast cache
TABLE_FEATURES = 10  # leaves of at most so many path features have a table of all patterns
PAIRS_PER_TASK = 20_000


def leaf_table(nodes: pd.DataFrame) -> dict[int, tuple]:
    """Leaves of one model grouped by the number of distinct path features.

    Each group is (features, lows, highs, shares, values): arrays of leaves by
    path features; a row reaches a leaf when low < x <= high for all of them.
    """
    groups: dict[int, list] = {}
    for _, tree in nodes.groupby("tree"):
        by_id = {r.id: r for r in tree.itertuples()}
        stack = [(0, {})]
        while stack:
            at, path = stack.pop()
            node = by_id[at]
            if node.feature < 0:
                groups.setdefault(len(path), []).append((path, node.value * node.weight))
                continue
            low, high, share = path.get(node.feature, (-np.inf, np.inf, 1.0))
            for child, bounds in ((node.left, (low, min(high, node.threshold))),
                                  (node.right, (max(low, node.threshold), high))):
                part = by_id[child].rows / node.rows
                stack.append((child, {**path, node.feature: (*bounds, share * part)}))
    return {m: (np.array([list(p) for p, _ in leaves], dtype=int).reshape(len(leaves), m),
                *[np.array([[c[i] for c in p.values()] for p, _ in leaves]).reshape(len(leaves), m)
                  for i in range(3)],
                np.array([v for _, v in leaves]))
            for m, leaves in groups.items()}


def pattern_values(known: np.ndarray, shares: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Contributions of path features (last axis) for patterns of conditions that hold.

    ``known`` and ``shares`` end in the path features of a leaf, ``values`` are the leaves'.
    """
    m = known.shape[-1]
    weights = np.array([factorial(k) * factorial(m - 1 - k) for k in range(m)]) / factorial(m)
    out = []
    for i in range(m):
        coeffs = [np.ones(np.broadcast_shapes(known.shape, shares.shape)[:-1])]
        for j in range(m):
            if j != i:
                absent = [c * shares[..., j] for c in coeffs] + [0.0]
                present = [0.0] + [c * known[..., j] for c in coeffs]
                coeffs = [a + p for a, p in zip(absent, present)]
        out.append(sum(w * c for w, c in zip(weights, coeffs)) * (known[..., i] - shares[..., i]) * values)
    return np.stack(out, -1)


def pattern_tables(leaves: dict[int, tuple]) -> dict[int, np.ndarray]:
    """For each group of leaves the contributions of every pattern: leaves x patterns x path features."""
    tables = {}
    for m, (_, _, _, shares, values) in leaves.items():
        if 0 < m <= TABLE_FEATURES:
            patterns = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
            tables[m] = pattern_values(patterns[None], shares[:, None], values[:, None])
    return tables


def shapley_values(leaves: dict[int, tuple], x: np.ndarray, tables: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Contributions (rows x features) for the rows of ``x``.

    A row and a leaf meet in a pattern, one bit for each path feature; what a
    pattern contributes is computed once, in a table or, for leaves of many path
    features, for the patterns that occur.
    """
    rows, width = x.shape
    tables = pattern_tables(leaves) if tables is None else tables
    phi = np.zeros((rows, width))
    for start in range(0, rows, ROWS_PER_STEP):
        add_from_tables(leaves, tables, x[start:start + ROWS_PER_STEP], phi[start:start + ROWS_PER_STEP])
    for m, (feats, lows, highs, shares, values) in leaves.items():
        if m == 0 or m in tables:
            continue
        step, leaf = max(1, CELLS_PER_STEP // len(feats)), np.arange(len(feats))
        for start in range(0, rows, step):
            part = x[start:start + step]
            code = np.zeros((len(part), len(feats)), np.int64)
            for j in range(m):
                picked = part[:, feats[:, j]]  # a missing value goes to the right
                holds = ~(picked <= lows[:, j]) & ((picked <= highs[:, j]) | np.isinf(highs[:, j]))
                code |= holds.astype(np.int64) << j
            met, at = np.unique(code + (leaf << m), return_inverse=True)
            at = at.reshape(code.shape)
            known = (met[:, None] >> np.arange(m) & 1).astype(float)
            table = pattern_values(known, shares[met >> m], values[met >> m])
            for i in range(m):
                order = np.argsort(feats[:, i], kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(feats[order, i]) > 0])
                phi[start:start + step, feats[order[first], i]] += np.add.reduceat(table[:, i][at[:, order]], first, axis=1)
    return phi


def add_from_tables(leaves: dict[int, tuple], tables: dict[int, np.ndarray], x: np.ndarray, phi: np.ndarray) -> None:
    """Add to ``phi`` what the leaves that have a table contribute, leaf by leaf on whole columns.

    Most conditions are shared by many leaves; each is compared once.
    """
    columns, sums, met = np.ascontiguousarray(x.T), np.zeros(x.shape[::-1]), {}

    def low_enough(f: int, bound: float) -> np.ndarray:
        if (f, bound) not in met:
            met[f, bound] = columns[f] <= bound
        return met[f, bound]

    for m, table in tables.items():
        feats, lows, highs = leaves[m][:3]
        table = table.transpose(0, 2, 1)  # leaves x path features x patterns
        for leaf, (own, low, high) in enumerate(zip(feats.tolist(), lows.tolist(), highs.tolist())):
            code, by_feature = np.zeros(len(x), np.intp), np.ascontiguousarray(table[leaf])
            for j, f in enumerate(own):
                # a missing value goes to the right
                holds = np.ones(len(x), bool) if low[j] == -np.inf else ~low_enough(f, low[j])
                if high[j] != np.inf:
                    holds = holds & low_enough(f, high[j])
                code += holds.view(np.uint8) * np.uint16(1 << j)
            for f, contribution in zip(own, by_feature):
                sums[f] += contribution[code]
    phi += sums.T


def feature_vector(model: OfferModel) -> Column:
    """The model inputs as one array, to travel with the recommendations."""
    return F.array(*[F.col(c).cast("double") for c in model.feature_names])


def explain_trees(model: OfferModel, pairs: DataFrame, k: int = 5, total: str | None = None) -> DataFrame:
    """Recommendations with their strongest feature contributions.

    ``pairs`` are recommendations with the array of model inputs as ``x``; only
    these pairs are explained. They are dealt out by offer, a frequent offer's
    over several tasks, and a task makes the tables of its offers. Executors get
    the nodes of all trees: offers times rounds times leaves, which the model's
    settings fix, not the data (195,000 nodes of 16 offers, 200 rounds and 31
    leaves, about 15 MB). ``total`` names a column for the sum of all contributions.
    """
    spark = pairs.sparkSession
    pairs = materialize(pairs, "pairs")
    # as long as the catalog
    parts = materialize(pairs.groupBy("offer_id").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_TASK).cast("int").alias("_parts")), "pair-counts")
    tasks = 2 * (parts.agg(F.sum("_parts")).first()[0] or 1)  # by hash: some stay empty, few get two
    dealt = pairs.join(F.broadcast(parts), "offer_id").withColumn("_part", F.pmod(F.xxhash64("member_id"), F.col("_parts"))).select(*pairs.columns, "_part")
    dealt = dealt.repartition(tasks, "offer_id", "_part").sortWithinPartitions("offer_id", "_part").drop("_part")
    shared = spark.sparkContext.broadcast({model.offer_ids[place]: part for place, part in model.nodes.groupby("ord")})

    order = np.argsort(np.argsort(model.feature_names))  # place of each name in the alphabet
    width = len(model.feature_names)

    def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = leaves = tables = None
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(-1, width)
            offers = batch["offer_id"].to_numpy(zero_copy_only=False)
            phi = np.zeros_like(x)
            for offer_id in np.unique(offers):
                at = np.flatnonzero(offers == offer_id)
                if offer_id != now:
                    now, leaves = offer_id, leaf_table(shared.value[offer_id])
                    tables = pattern_tables(leaves)
                phi[at] = shapley_values(leaves, x[at], tables)
            best = np.lexsort((np.broadcast_to(order, phi.shape), -np.abs(phi)), axis=1)[:, :k]
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * best.shape[1])
            as_lists = lambda values: pa.ListArray.from_arrays(ends, pa.array(values.ravel()))
            kept = batch.drop_columns(["x"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, as_lists(best.astype(np.int32)), as_lists(np.take_along_axis(x, best, 1)),
                 as_lists(np.take_along_axis(phi, best, 1)), pa.array(phi.sum(1))], [*kept.schema.names, "_at", "_value", "_phi", "_total"])

    kept = [f for f in pairs.schema if f.name != "x"]
    numbers = ArrayType(DoubleType())
    schema = StructType([*kept, StructField("_at", ArrayType(IntegerType())), StructField("_value", numbers),
                         StructField("_phi", numbers), StructField("_total", DoubleType())])
    names = F.lit(model.feature_names)
    factors = F.transform(F.arrays_zip("_at", "_value", "_phi"), lambda z: F.struct(
        F.element_at(names, z["_at"] + 1).alias("feature"), round_even(z["_value"], 2).alias("value"),
        (round_even(z["_phi"], 3) + 0.0).alias("shap_value"),
        F.when(z["_phi"] > 0, "increases").otherwise("decreases").alias("direction")))
    explained = dealt.mapInArrow(contributions, schema).withColumn("top_features", factors).drop("_at", "_value", "_phi")
    return explained.withColumnRenamed("_total", total) if total else explained.drop("_total")
