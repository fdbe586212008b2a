"""Boosted regression trees of several targets, grown together on histograms.

Features are binned once by exact quantiles; a row is then its bins, its
residuals (one for each target) and a hash for sampling. One job looks at new
nodes of all targets' trees: a task sums up residuals and weights by (target,
node, feature, bin), the sums of a (target, node) meet in one task, and only
its best split comes back. Trees grow leaf by leaf, best gain first: the splits
that would be chosen by what is known are made in advance, their children are
looked at in the next job, and when nothing that could be chosen is unknown the
order of gains settles which splits count. A node of at most ``ROWS_IN_TASK``
rows is not looked at again: its rows go to one task, which finds all splits
below it. Residuals after a round are kept by the executors, so that all jobs of
the next round read them; every ``ROUNDS_PER_WRITE`` rounds they are written.

Trees of one target never need another target's residuals. Up to ``ROWS_WHOLE``
rows each target's rows therefore go to one task, once, which runs all its
rounds; the splits are the same. Such a task holds about 100 bytes a row for 96
features: the joint bins (:class:`Histograms`), from which a feature's bin is
looked up, residuals, and the places of the sampled rows.

Residuals are summed as whole numbers of 2^-16, so sums do not depend on how
the rows are split, and row and feature samples come from hashes: a model is
the same on any cluster. A missing value (null or NaN) goes to the right of
every split.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from offerrank.operators.quantiles import exact_quantiles
from offerrank.session import materialize, scratch_path

BINS = 64
LEAST_ROWS = 20  # in a leaf, counted by weight
ROWS_PER_SAMPLE = 5  # rounds that share a sample of rows
ROUNDS_PER_WRITE = 10
UNIT = float(1 << 16)
ROWS_IN_TASK = 1 << 16  # weight of a node whose rows are grown on in one task
FEW_ROWS, MANY_ROWS = 1 << 12, 1 << 18  # in a task, when there are few or many
ROWS_AT_ONCE = 1 << 16  # of a task
SIDE = BINS  # of a joint histogram of SIDE x SIDE cells
ROWS_PER_SUM = 1 << 14  # added up at once
ROWS_FOR_JOINT = 400  # of a node; fewer are counted feature by feature
ROWS_WHOLE = 1 << 23  # of a training table; of more, no task holds all
ROWS_PER_BLOCK = 1 << 14  # sent to a target's task together


class Tree:
    """All nodes looked at so far; which of their splits count is settled by :meth:`chosen`.

    ``best`` of a node is its best split (gain, feature, cut, sums to the left),
    None while it is not known. ``way`` is the path from the root, which breaks ties.
    """

    def __init__(self, way: str = ""):
        self.sums, self.best, self.children, self.way = [(0.0, 0.0)], [None], [None], [way]

    def add(self, way: str) -> int:
        for column, value in ((self.sums, (0.0, 0.0)), (self.best, None), (self.children, None), (self.way, way)):
            column.append(value)
        return len(self.way) - 1

    def expand(self, node: int) -> tuple[int, int]:
        _, _, _, gl, hl = self.best[node]
        g, h = self.sums[node]
        self.children[node] = self.add(self.way[node] + "l"), self.add(self.way[node] + "r")
        for child, sums in zip(self.children[node], ((gl, hl), (g - gl, h - hl))):
            self.sums[child] = sums
        return self.children[node]

    def chosen(self, splits: int, depth: int | None = None) -> list[int]:
        """The nodes that are split, best gain first, as far as gains are known."""
        def ready(node: int) -> list[tuple]:
            best = self.best[node]
            deep = depth is not None and len(self.way[node]) >= depth
            return [] if best is None or best[0] <= 0 or deep else [(-best[0], self.way[node], node)]
        heap, order = ready(0), []
        while heap and len(order) < splits:
            node = heapq.heappop(heap)[2]
            order.append(node)
            for child in self.children[node] or ():
                for entry in ready(child):
                    heapq.heappush(heap, entry)
        return order

    def wanted(self, splits: int, depth: int | None = None) -> list[int]:
        """New nodes to look at: their splits may come before the last one that is chosen."""
        order = self.chosen(splits, depth)
        return [c for i, n in enumerate(order) if self.children[n] is None and (i + 1 < splits) for c in self.expand(n)]

    def arrays(self, of: list[int] | None = None) -> tuple[np.ndarray, ...]:
        """feature, cut, left, right by node and the largest depth; only the splits in ``of``, or all made."""
        made = {n for n, c in enumerate(self.children) if c is not None} if of is None else set(of)
        feature, cut, left, right = (np.full(len(self.way), -1, np.int32) for _ in range(4))
        for n in made:
            feature[n], cut[n] = self.best[n][1:3]
            left[n], right[n] = self.children[n]
        return feature, cut, left, right, max((len(self.way[n]) - len(self.way[0]) + 1 for n in made), default=0)

    def final(self, splits: int, depth: int | None) -> "Tree":
        """Only what is chosen, in its order."""
        out, place = Tree(), {0: 0}
        out.sums[0] = self.sums[0]
        for n in self.chosen(splits, depth):
            out.best[place[n]] = self.best[n]
            made = out.expand(place[n])
            place.update(zip(self.children[n] or (), made))
        return out

    @property
    def value(self) -> np.ndarray:
        return np.array([g / h / UNIT if h else 0.0 for g, h in self.sums])


def leaf_of(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """The node where each row of ``x`` ends; ``x`` and ``cut`` are both bins or both values."""
    node, row = np.zeros(len(x), np.int32), np.arange(len(x))
    for _ in range(depth):
        f = feature[node]
        node = np.where(f < 0, node, np.where(x[row, f] <= cut[node], left[node], right[node]))
    return node


def leaf_of_columns(columns: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """:func:`leaf_of` with one row of ``columns`` for each feature: whole columns are compared, each split once."""
    n, kind = columns.shape[1], np.uint8 if len(feature) <= 256 else np.int32
    inside, out = {0: np.ones(n, bool)}, np.zeros(n, kind)
    for node, (f, c, a, b) in enumerate(zip(feature.tolist(), cut.tolist(), left.tolist(), right.tolist())):
        if node not in inside:
            continue
        own = inside.pop(node)
        if f < 0:
            out += own.view(np.uint8) * kind(node)
        else:
            low = columns[f] <= c
            inside[a], inside[b] = own & low, own > low
    return out


def feature_edges(data: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Rising upper edges of each feature's bins; all values equal give none."""
    probs = [k / bins for k in range(1, bins)]
    rows = exact_quantiles(data, features, probs).collect()
    found: dict[str, set[float]] = {}
    for r in rows:
        found.setdefault(r["column"], set()).add(r["value"])
    tops = data.agg(*[F.max(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(str(k)) for k, c in enumerate(features)]).first()
    return [np.array(sorted(v for v in found.get(c, ()) if v < top)) for c, top in zip(features, tops)]


def sampled(draw: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Which rows are in the sample of a turn."""
    h = draw ^ np.uint64((seed * 1_000_003 + turn) * 0x9E3779B97F4A7C15 % (1 << 64))
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ h >> np.uint64(30)) * np.uint64(m)
    return (h >> np.uint64(11)) < np.uint64(share * (1 << 53))


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def feature_array(features: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])


@dataclass
class Boosted:
    """Trees of each round and target, with what turns bins into values."""
    edges: list[np.ndarray]
    means: list[float]
    trees: list[list[Tree]]
    rate: float

    def nodes(self) -> Iterator[tuple]:
        """(target, tree, weight, id, value, rows, left, right, feature, threshold); the first tree of a target is its mean."""
        for k, mean in enumerate(self.means):
            yield k, 0, 1.0, 0, mean, 1.0, -1, -1, -1, None
            for r, trees in enumerate(self.trees):
                t, value = trees[k], trees[k].value
                feature, cut, left, right, _ = t.arrays()
                for i, f in enumerate(feature.tolist()):
                    yield k, r + 1, self.rate, i, float(value[i]), float(t.sums[i][1]), int(left[i]), int(right[i]), f, float(self.edges[f][cut[i]]) if f >= 0 else None


class Histograms:
    """Sums by (leaf, feature, bin), bins of all features side by side.

    Features of few bins are counted together: a row adds to one cell of a square
    of ``SIDE`` by ``SIDE`` cells, whose rows and columns each stand for a feature
    or for the joint bins of several. All squares are then summed up at once.
    """

    def __init__(self, edges: list[np.ndarray]):
        self.sizes = np.array([len(e) + 1 for e in edges])
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        self.width = int(self.sizes.sum())
        sides: list[list[int]] = []  # features that share a side of a square
        for f in np.argsort(-self.sizes, kind="stable").tolist():
            side = next((x for x in sides if np.prod(self.sizes[x]) * self.sizes[f] <= SIDE), None)
            if side is None:
                sides.append([f])
            else:
                side.append(f)
        self.squares = [sides[k:k + 2] for k in range(0, len(sides), 2)]
        self.groups = [sum(square, []) for square in self.squares]
        parts: list[np.ndarray] = [np.zeros(0, np.intp)] * self.width  # the cells of all sides that make up each bin
        for k, side in enumerate(sides):
            k += k % 2 == 0 and k + 1 == len(sides)  # alone in the last square
            cell, step = np.arange(np.prod(self.sizes[side])), 1
            for f in side[::-1]:  # the last feature changes fastest
                for b in range(self.sizes[f]):
                    parts[self.starts[f] + b] = k * SIDE + cell[cell // step % self.sizes[f] == b]
                step *= self.sizes[f]
        self.cells, self.cell_starts = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])[:-1]]
        self.square_of, self.bin_of = np.zeros(len(edges), np.intp), np.zeros((len(edges), SIDE * SIDE), np.uint8)  # of a feature, its bin by cell
        cell = np.arange(SIDE * SIDE)
        for k, square in enumerate(self.squares):
            for place, side in enumerate(square):
                digit, step = cell // SIDE if place + 1 < len(square) else cell % SIDE, 1
                for f in side[::-1]:
                    self.square_of[f], self.bin_of[f] = k, digit // step % self.sizes[f]
                    step *= self.sizes[f]

    def codes(self, columns: np.ndarray) -> np.ndarray:
        """The cell of each row in each square."""
        out = np.zeros((len(self.squares), columns.shape[1]), np.uint16)
        for code, square in zip(out, self.squares):
            for side in square:
                own = np.zeros(columns.shape[1], np.uint8)  # bins of one feature, or at most SIDE cells
                for f in side:
                    own *= np.uint8(self.sizes[f] % 256)
                    own += columns[f]
                code *= np.uint16(SIDE)
                code += own
        return out

    def low(self, codes: np.ndarray, f: int, cut: int, rows: np.ndarray) -> np.ndarray:
        """Whether the feature's bin is ``cut`` at most, in some rows."""
        return np.take(self.bin_of[f] <= cut, np.take(codes[self.square_of[f]], rows))

    def leaves(self, codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf and its rows, those without rows left out."""
        below = [(0, np.arange(codes.shape[1]))]
        while below:
            node, rows = below.pop()
            if feature[node] < 0:
                yield node, rows
            elif len(rows):
                low = self.low(codes, feature[node], cut[node], rows)
                below += [(left[node], rows[low]), (right[node], rows[~low])]

    def of(self, columns: np.ndarray | None, codes: np.ndarray, rows: np.ndarray | None, q: np.ndarray, w: np.ndarray | None, mask: np.ndarray,
           slot: np.ndarray | None = None, slots: int = 1) -> np.ndarray:
        """Residuals and weights (None: all 1) of some rows (None: all): 2 x slots x width. Without ``columns`` bins are looked up in ``codes``."""
        if len(q) < ROWS_FOR_JOINT * slots:
            if columns is None:
                at = np.arange(len(q)) if rows is None else rows
                own = self.bin_of[mask[:, None], codes[self.square_of[mask][:, None], at]]
            else:
                own = columns[mask] if rows is None else columns[mask[:, None], rows]
            index = own + self.starts[mask][:, None]
            if slot is not None:
                index += slot * self.width
            index, w = index.ravel(), np.ones(len(q)) if w is None else w
            return np.stack([np.bincount(index, np.tile(v, len(mask)), slots * self.width).reshape(slots, self.width) for v in (q, w)])
        if len(q) > ROWS_PER_SUM * slots:  # few enough for a fast cache, and for one number to hold both sums
            parts = [slice(k, k + ROWS_PER_SUM * slots) for k in range(0, len(q), ROWS_PER_SUM * slots)]
            return sum(self.of(columns[:, p] if rows is None and columns is not None else columns, codes[:, p] if rows is None else codes,
                               None if rows is None else rows[p], q[p], None if w is None else w[p], mask, None if slot is None else slot[p], slots) for p in parts)
        scale = 0.0
        if w is None:  # one number holds both, if its 53 bits are enough for the largest sums
            scale = 2.0 ** np.ceil(np.log2(2 * len(q) * np.abs(q).max(initial=1) + 1))
            scale = scale if scale * (len(q) + 1) < 2 ** 53 else 0.0
        values = (q + scale,) if scale else (q, np.ones(len(q)) if w is None else w)
        squares, out = np.empty((len(values), slots, len(self.squares), SIDE * SIDE)), np.empty((2, slots, self.width))
        for at, code in enumerate(codes):
            code = code if rows is None else code[rows]
            code = code if slot is None else code + slot * SIDE * SIDE
            for j, v in enumerate(values):
                squares[j, :, at] = np.bincount(code, v, slots * SIDE * SIDE).reshape(slots, -1)
        squares = squares.reshape(len(values), slots, -1, SIDE, SIDE)
        sides = np.stack([squares.sum(4), squares.sum(3)], 3).reshape(len(values), slots, -1)
        np.add.reduceat(sides[:, :, self.cells], self.cell_starts, axis=2, out=out[:len(values)])
        if scale:
            out[1] = np.rint(out[0] / scale)
            out[0] -= out[1] * scale
        return out

    def open(self, mask: np.ndarray) -> np.ndarray:
        """The bins behind which a split may lie: not the last of a feature, nor those of other features."""
        out = np.repeat(np.isin(np.arange(len(self.sizes)), mask), self.sizes)
        out[self.starts + self.sizes - 1] = False
        return out

    def best_cut(self, sums: np.ndarray, mask: np.ndarray, open_: np.ndarray | None = None) -> tuple[tuple, tuple]:
        """(gain, feature, last bin to the left, sums to the left), and all sums; ties go to the first feature and bin."""
        starts, sizes = self.starts, self.sizes
        run = np.cumsum(sums, axis=1)
        gl, hl = run - np.repeat(np.where(starts > 0, run[:, starts - 1], 0), sizes, axis=1)
        g, h = sums[:, starts[mask[0]]:starts[mask[0]] + sizes[mask[0]]].sum(1)
        gr, hr = g - gl, h - hl
        allowed = (self.open(mask) if open_ is None else open_) & (hl >= LEAST_ROWS) & (hr >= LEAST_ROWS)
        with np.errstate(all="ignore"):
            gain = np.where(allowed, gl * gl / hl + gr * gr / hr - (g * g / h if h else 0.0), 0.0) / (UNIT * UNIT)
        at = int(np.argmax(gain))
        if not gain[at] > 1e-9:
            return (0.0, -1, 0, 0.0, 0.0), (float(g), float(h))
        f = int(np.searchsorted(starts, at, side="right")) - 1
        return (float(gain[at]), f, at - int(starts[f]), float(gl[at]), float(hl[at])), (float(g), float(h))

    def grow(self, columns: np.ndarray | None, q: np.ndarray, w: np.ndarray | None, mask: np.ndarray, splits: int, depth: int | None, way: str,
             codes: np.ndarray | None = None, rows: np.ndarray | None = None) -> Tree:
        """The best splits below one node whose rows (None: all) are here; a child's sums are its parent's less its sibling's."""
        tree, own, open_ = Tree(way), {0: np.arange(len(q)) if rows is None else rows}, self.open(mask)
        w = None if w is None or (w == 1).all() else w
        if codes is None:
            codes = self.codes(columns) if len(q) >= ROWS_FOR_JOINT else []

        def sums_of(at: np.ndarray | None) -> np.ndarray:
            return self.of(columns, codes, at, q if at is None else q[at], w if w is None or at is None else w[at], mask)[:, 0]
        sums = {0: sums_of(rows)}
        tree.best[0], tree.sums[0] = self.best_cut(sums[0], mask, open_)
        while new := tree.wanted(splits, depth):
            parent = {c[0]: n for n, c in enumerate(tree.children) if c is not None}
            for a, b in zip(new[::2], new[1::2]):
                n = parent[a]
                at, (_, f, cut, _, _) = own.pop(n), tree.best[n]
                to_left = self.low(codes, f, cut, at) if columns is None else columns[f][at] <= cut
                own[a], own[b] = at[to_left], at[~to_left]
                few, many = (a, b) if len(own[a]) <= len(own[b]) else (b, a)
                sums[few] = sums_of(own[few])
                sums[many] = sums.pop(n) - sums[few]
                for c in (a, b):
                    tree.best[c], tree.sums[c] = self.best_cut(sums[c], mask, open_)
        return tree


def feature_masks(seed: int, r: int, n_targets: int, n_features: int, share: float) -> list[np.ndarray]:
    """The features that each target's tree of a round may split by."""
    draws = [np.random.default_rng([seed, r, k]) for k in range(n_targets)]
    return [np.sort(d.permutation(n_features)[:max(1, round(share * n_features))]) for d in draws]


def key_of_each_part(spark: SparkSession, parts: int) -> list[int]:
    """Keys (long) that ``repartition(parts, key)`` deals out to a task each; if two met in one, only time would be lost."""
    keys = spark.range(64 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("part")).agg(F.min("id").alias("key")).collect()
    found = {r["part"]: r["key"] for r in keys}
    return [found.get(k, k) for k in range(parts)]


def chunks(batches: Iterator[pa.RecordBatch], at_once: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows, ``at_once`` or a batch more at once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= at_once:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def fit(data: DataFrame, features: list[str], targets: list[str], rounds: int, leaves: int, rate: float, row_share: float, feature_share: float,
        seed: int, key: str, weight: str | None = None, depth: int | None = None, rows_in_task: int | None = None) -> Boosted:
    spark = data.sparkSession
    data = materialize(data.select(F.xxhash64(key).alias("draw"), feature_array(features).alias("x"), F.array(*[F.col(t).cast("double") for t in targets]).alias("y"),
                                   (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")), "training")
    columns = [f"x{k}" for k in range(len(features))]
    edges = feature_edges(data.select(*[F.col("x")[k].alias(c) for k, c in enumerate(columns)]), columns)
    sums = data.agg(F.count("*"), F.sum("w"), *[F.sum((F.rint(F.col("y")[k] * UNIT) * F.col("w")).cast("decimal(38,6)")) for k in range(len(targets))]).first()
    count, total = sums[0], sums[1] or 0.0
    means = [float(s) / UNIT / total if total else 0.0 for s in sums[2:]]
    whole = rows_in_task is None and count <= ROWS_WHOLE
    if rows_in_task is None:  # of many rows, moving sums costs less than moving all nodes' rows
        rows_in_task = ROWS_IN_TASK if total * row_share <= 4 * ROWS_IN_TASK else ROWS_IN_TASK // 4
    tasks = max(1, min(-(-count // FEW_ROWS), max(spark.sparkContext.defaultParallelism, -(-count // MANY_ROWS))))
    bins_of, n_targets, splits = Histograms(edges), len(targets), leaves - 1

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(edges))
            bins = np.stack([np.where(np.isnan(x[:, k]), len(e), np.searchsorted(e, x[:, k])) for k, e in enumerate(edges)], 1).astype(np.uint8)
            rest = b.column(2).flatten().to_numpy().reshape(-1, n_targets) - np.array(means)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in bins], pa.binary()), pa.array([r.tobytes() for r in rest], pa.binary()), b.column(3)],
                                             ["draw", "bins", "rest", "w"])

    def after(rows: DataFrame, trees: list[tuple]) -> DataFrame:
        """The rows with the residuals that one round's trees leave."""
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins, rest = (np.ascontiguousarray(matrix(b.column(c), t).T) for c, t in ((1, "u1"), (2, "f8")))
                for start in range(0, b.num_rows, FEW_ROWS):  # few enough for a fast cache
                    part, own = np.ascontiguousarray(bins[:, start:start + FEW_ROWS]), rest[:, start:start + FEW_ROWS]
                    for k, (arrays, value) in enumerate(trees):
                        own[k] -= (rate * value)[leaf_of_columns(part, *arrays)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in np.ascontiguousarray(rest.T)], pa.binary()), b.column(3)],
                                                 ["draw", "bins", "rest", "w"])
        return rows.mapInArrow(work, schema)

    def look_at(rows: DataFrame, turn: int, growing: dict[int, tuple], masks: list[np.ndarray]) -> list:
        """Best splits of new nodes. ``growing`` has of each target the tree so far, the place of each new node, which of
        these are few rows (they come whole to one task, which goes on to their children), and their ways."""
        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in chunks(batches):
                bins, rest = (np.ascontiguousarray(matrix(b.column(c), t).T) for c, t in ((1, "u1"), (2, "f8")))
                keep = np.flatnonzero(sampled(b.column(0).to_numpy().view(np.uint64), seed, turn, row_share))
                bins, w = np.take(bins, keep, axis=1), b.column(3).to_numpy()[keep]
                codes = bins_of.codes(bins) if any(not few.all() for _, _, few, _ in growing.values()) else []
                by_row = np.ascontiguousarray(bins.T) if any(few.any() for _, _, few, _ in growing.values()) else None
                alike, out = (w == 1).all(), []
                for k, (arrays, slots, few, _) in growing.items():
                    slot = slots[leaf_of_columns(bins, *arrays)]
                    q = np.rint(rest[k, keep] * UNIT) * w
                    if not few.all():
                        at = np.flatnonzero((slot >= 0) & ~few[slot])
                        sums = bins_of.of(bins, codes, at, q[at], None if alike else w[at], masks[k], slot[at], len(few))
                        total[k] = total[k] + sums if k in total else sums
                    for s in np.flatnonzero(few):
                        at = np.flatnonzero(slot == s)
                        if len(at):
                            out.append((k, s, by_row[at].tobytes(), np.stack([q[at], w[at]]).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
            for k, sums in total.items():
                at = np.flatnonzero(~growing[k][2])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array([None] * len(at), pa.binary()),
                                                  pa.array([sums[:, s].tobytes() for s in at], pa.binary())], names)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: dict[tuple[int, int], list] = {}
            for b in batches:
                for k, s, bins, raw in zip(*(c.to_pylist() for c in b.columns)):
                    if bins is None:
                        part = np.frombuffer(raw).reshape(2, -1)
                        met[k, s] = [met[k, s][0] + part] if (k, s) in met else [part]
                    else:
                        met.setdefault((k, s), []).append((np.frombuffer(bins, np.uint8).reshape(-1, len(edges)), np.frombuffer(raw).reshape(2, -1)))
            out = []
            for (k, s), parts in met.items():
                if growing[k][2][s]:
                    bins, (q, w) = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1)
                    tree = bins_of.grow(np.ascontiguousarray(bins.T), q, w, masks[k], splits, depth, growing[k][3][s])
                else:
                    tree = Tree()
                    tree.best[0], tree.sums[0] = bins_of.best_cut(parts[0], masks[k])
                out.extend((k, s, n, *tree.best[n], *tree.sums[n], *(tree.children[n] or (-1, -1))) for n in range(len(tree.way)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], result.replace(" long", "").replace(" double", "").split(", "))

        names, kinds = ["target", "slot", "bins", "sums"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        result = "target long, slot long, node long, gain double, feature long, cut long, gl double, hl double, g double, h double, left long, right long"
        many = sum(len(few) for _, _, few, _ in growing.values())
        sums = rows.mapInArrow(add_up, "target int, slot int, bins binary, sums binary")
        if tasks > 1 or many > 1:
            sums = sums.repartition(min(many, spark.sparkContext.defaultParallelism * 4), "target", "slot")
        return sums.mapInArrow(choose, result).collect()

    def by_target(rows: DataFrame) -> list[list[Tree]]:
        """The trees of each round, every target's grown in a task of its own."""
        keys = key_of_each_part(spark, n_targets)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, ROWS_PER_BLOCK):
                draw, w = b.column(0).to_numpy().tobytes(), b.column(3).to_numpy()
                bins, rest = (np.ascontiguousarray(matrix(b.column(c), t).T) for c, t in ((1, "u1"), (2, "f8")))
                codes, w = bins_of.codes(bins).tobytes(), None if (w == 1).all() else w.tobytes()
                for k in range(n_targets):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((keys[k], k, draw, codes, rest[k].tobytes(), w), kinds)], names)

        def boost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple] = {}
            for b in batches:
                for i in range(b.num_rows):
                    k = b.column(1)[i].as_py()
                    if k not in held:  # every target has all rows
                        held[k] = [0], np.empty((len(bins_of.squares), count), np.uint16), np.empty(count, np.uint64), np.empty(count), np.ones(count if weight else 0)
                    (at,), codes, *rest = held[k]
                    raw = [np.frombuffer(c[i].as_buffer(), t) if c[i].is_valid else 1.0 for c, t in zip(b.columns[2:], (np.uint64, np.uint16, float, float))]
                    n = len(raw[0])
                    codes[:, at:at + n] = raw[1].reshape(-1, n)
                    for column, part in zip(rest, (raw[0], raw[2], raw[3])):
                        column[at:at + n] = part
                    held[k][0][0] += n
            while held:
                k, (_, codes, draw, rest, w) = held.popitem()
                w, trees = w if weight else None, []
                for r in range(rounds):
                    if r % ROWS_PER_SAMPLE == 0:
                        keep = np.flatnonzero(sampled(draw, seed, r // ROWS_PER_SAMPLE, row_share))
                    mask = feature_masks(seed, r, n_targets, len(features), feature_share)[k]
                    q = np.rint(rest * UNIT)
                    if weight:
                        q *= w
                    trees.append(bins_of.grow(None, q, w, mask, splits, depth, "", codes, keep).final(splits, depth))
                    (*arrays, _), value = trees[-1].arrays(), rate * trees[-1].value
                    for start in range(0, len(rest), ROWS_AT_ONCE):
                        part = rest[start:start + ROWS_AT_ONCE]
                        for leaf, at in bins_of.leaves(codes[:, start:start + ROWS_AT_ONCE], *arrays):
                            part[at] -= value[leaf]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pickle.dumps(trees)], pa.binary())], ["target", "trees"])

        names, kinds = ["key", "target", "draw", "codes", "rest", "w"], [pa.int64(), pa.int32(), *[pa.binary()] * 4]
        dealt = rows.mapInArrow(deal, "key long, target int, draw binary, codes binary, rest binary, w binary").repartition(n_targets, "key")
        grown = {r["target"]: pickle.loads(r["trees"]) for r in dealt.mapInArrow(boost, "target int, trees binary").collect()}
        return [[grown[k][r] for k in range(n_targets)] for r in range(rounds)]

    schema = "draw long, bins binary, rest binary, w double"
    rows = materialize(data.repartition(tasks).mapInArrow(to_bins, schema), "residuals")
    if whole and count:
        return Boosted(edges, means, by_target(rows), rate)
    model, kept = Boosted(edges, means, [], rate), []
    for r in range(rounds):
        masks = feature_masks(seed, r, n_targets, len(features), feature_share)
        trees, new = [Tree() for _ in targets], {k: [0] for k in range(n_targets)}
        while new:
            growing = {}
            for k, nodes in new.items():
                t, slots = trees[k], np.full(len(trees[k].way), -1)
                slots[nodes] = np.arange(len(nodes))
                few = np.array([(t.sums[n][1] if n else total * row_share) <= rows_in_task for n in nodes])
                growing[k] = t.arrays(), slots, few, [t.way[n] for n in nodes]
            graft(trees, new, look_at(rows, r // ROWS_PER_SAMPLE, growing, masks))
            new = {k: nodes for k, t in enumerate(trees) if (nodes := t.wanted(splits, depth))}
        trees = [t.final(splits, depth) for t in trees]
        model.trees.append(trees)
        if r + 1 < rounds:
            rows = after(rows, [(t.arrays(), t.value) for t in trees])
            if (r + 1) % ROUNDS_PER_WRITE:
                kept.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
            else:
                rows = materialize(rows, "residuals")
            while len(kept) > (2 if (r + 1) % ROUNDS_PER_WRITE else 0):  # the last but one has been read
                kept.pop(0).unpersist()
    while kept:
        kept.pop().unpersist()
    return model


def graft(trees: list[Tree], looked: dict[int, list[int]], found: list) -> None:
    """Put what was found below each new node where it belongs."""
    place: dict[tuple, int] = {}
    for row in sorted(found, key=lambda x: (x["target"], x["slot"], x["node"])):
        t, own = trees[row["target"]], (row["target"], row["slot"])
        at = place.get((*own, row["node"]), looked[row["target"]][row["slot"]])
        t.best[at], t.sums[at] = tuple(row[c] for c in ("gain", "feature", "cut", "gl", "hl")), (row["g"], row["h"])
        if row["left"] >= 0:
            for child, made in zip((row["left"], row["right"]), t.expand(at)):
                place[(*own, child)] = made
    for k, nodes in looked.items():  # a node without sampled rows
        for n in nodes:
            trees[k].best[n] = trees[k].best[n] or (0.0, -1, 0, 0.0, 0.0)
