"""Whitening of embeddings by incremental eigendecomposition.

Entries c become integers floor(256 c); the fit list is each distinct integer
vector once. A task keeps the spectrum (count, mean, eigenvalues and vectors of
the centred scatter) of the vectors it has seen. A vector x changes the scatter
by the rank-one term n / (n + 1) (x - mean)(x - mean)^T: with the eigenvectors
as basis this is D + rho z z^T, whose eigenvalues are the roots of the secular
equation 1 + rho sum z_j^2 / (d_j - t) = 0, one between each two poles.
Entries of z that are too small to matter, and poles too close to tell apart
(one of each pair is turned out by a rotation), are deflated first. Vectors
come from z recomputed from the roots (Gu and Eisenstat), so they are
orthogonal. Two spectra are combined in the same way: one update for each
eigenvector of the second and one for the distance of the means, in rounds of
``FAN_IN`` spectra a task.

The updates leave rounding behind that grows with their number. The last step
takes it away: the combined vectors are made orthonormal, every task projects
its centred vectors on them and adds up one small matrix, and the eigenvectors
of the sum turn the basis (Rayleigh-Ritz). As the basis spans the space, the
result is the spectrum of the covariance to double precision.

Rows whose vector is null, or holds null or non-finite entries or such beyond
2^44, are left out. Vectors of another length are fitted apart. A component
without variance (eigenvalue not above rounding) cannot be whitened and gives no
row, so a single distinct vector gives none. Null ids and repeated rows come
back; only the named columns are read. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerrank.llm.common import Scratch, in_batches, table, whole_groups

SCALE = 256
LARGEST = float(1 << 44)
FAN_IN = 8
COMPONENTS = 4
EPS = np.finfo(np.float64).eps
LIMB = 26  # sums of integers are kept as two numbers, of the high and the low bits


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho sum z2_j / (d_j - t), d rising and z2 > 0: nearest pole and distance from it.

    All roots at once, by interpolation with the two poles around each root
    ("middle way"); a step that leaves the bracket is replaced by its middle.
    """
    k = len(d)
    upper = np.r_[d[1:], d[-1] + rho * z2.sum()]
    gap = upper - d
    index = np.arange(k)
    middle = 1 + rho * (z2[None, :] / (d[None, :] - (d + gap / 2)[:, None])).sum(1)
    origin = np.where((middle >= 0) | (index == k - 1), index, np.minimum(index + 1, k - 1))
    shifted = d[None, :] - d[origin][:, None]  # poles as seen from the origin of each root
    low = np.where(origin == index, 0.0, -gap)
    high = np.where(origin == index, gap, 0.0)
    right = np.where((origin == index) & (index < k - 1), gap / 2, high)
    left = np.where(origin == index, low, -gap / 2)
    low, high = np.maximum(low, left), np.minimum(high, right)
    t = (low + high) / 2
    below = index[None, :] <= index[:, None]
    if k > 1:
        below[-1, -1] = False  # the last root lies above both of its poles
    one = np.arange(k) if k == 1 else np.minimum(index, k - 2)
    two = np.minimum(one + 1, k - 1)
    last = (index == k - 1) & (k > 1)
    lower, weights = below.astype(np.float64), rho * z2
    higher = 1 - lower
    for _ in range(60):
        gaps = shifted - t[:, None]
        terms = weights / gaps
        f = 1 + terms.sum(1)
        high, low = np.where(f > 0, t, high), np.where(f > 0, low, t)
        slopes = terms / gaps
        psi, phi = np.einsum("ij,ij->i", slopes, lower), np.einsum("ij,ij->i", slopes, higher)
        g1, g2 = gaps[index, one], gaps[index, two]
        c = f - g1 * psi - g2 * phi
        a = (g1 + g2) * f - g1 * g2 * (psi + phi)
        b = g1 * g2 * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(all="ignore"):
            inner = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            outer = np.where(a >= 0, (a + root) / (2 * c), 2 * b / (a - root))
        step = t + np.where(last, outer, inner)
        bad = ~np.isfinite(step) | (step <= low) | (step >= high)
        new = np.where(bad, (low + high) / 2, step)
        done = (np.abs(new - t) <= 2 * EPS * np.abs(new)) | (np.abs(f) <= 4 * EPS * (1 + np.einsum("ij,ij->i", terms, higher - lower))) | (high - low <= 2 * EPS * np.abs(new))
        t = np.where(done, t, new)
        if done.all():
            break
    return origin, t


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of u diag(d) u^T + rho v v^T for rho >= 0; d rises before and after."""
    z = v @ u
    size = np.linalg.norm(z)
    if rho <= 0 or size == 0:
        return d, u
    rho, z = rho * size * size, z / size
    limit = 8 * EPS * max(np.abs(d).max(), rho)
    free = rho * np.abs(z) > limit
    at = np.flatnonzero(free)
    if len(at) > 1:
        near = np.flatnonzero(np.diff(d[at]) * np.abs(z[at[:-1]] * z[at[1:]]) <= limit * (z[at[:-1]] ** 2 + z[at[1:]] ** 2))
        if len(near):
            u, z, d = u.copy(), z.copy(), d.copy()
            i = at[0]
            for j in at[1:]:
                r = np.hypot(z[i], z[j])
                c, s = z[j] / r, z[i] / r
                if (d[j] - d[i]) * abs(c * s) <= limit:  # z_i is turned to nothing, its pair stays as it is
                    u[:, i], u[:, j] = c * u[:, i] - s * u[:, j], s * u[:, i] + c * u[:, j]
                    d[i], d[j] = c * c * d[i] + s * s * d[j], s * s * d[i] + c * c * d[j]
                    z[i], z[j], free[i] = 0.0, r, False
                i = j
            at = np.flatnonzero(free)
            order = np.argsort(d[at], kind="stable")
            at = at[order]
    if not len(at):
        return d, u
    poles = d[at]
    origin, t = secular_roots(poles, z[at] ** 2, rho)
    away = (poles[None, :] - poles[origin][:, None]) - t[:, None]  # pole j - root i
    ratio = -away / np.where(np.eye(len(at), dtype=bool), 1.0, poles[None, :] - poles[:, None])
    fresh = np.sqrt(np.abs(np.prod(ratio, axis=0) / rho)) * np.where(z[at] < 0, -1, 1)
    w = fresh[None, :] / away
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    d, out = d.copy(), u.copy()
    d[at] = poles[origin] + t
    out[:, at] = u[:, at] @ w.T
    order = np.argsort(d, kind="stable")
    return d[order], out[:, order]


@dataclass
class Spectrum:
    """Count, sums (high and low bits), mean, and spectrum of the centred scatter."""
    n: int
    high: np.ndarray
    low: np.ndarray
    mean: np.ndarray
    d: np.ndarray
    u: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> "Spectrum":
        return cls(0, np.zeros(dim, np.int64), np.zeros(dim, np.int64), np.zeros(dim), np.zeros(dim), np.eye(dim))

    def add(self, x: np.ndarray) -> None:
        """One integer vector."""
        self.high += x >> LIMB
        self.low += x & ((1 << LIMB) - 1)
        away = x - self.mean
        if self.n:
            self.d, self.u = rank_one(self.d, self.u, away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def join(self, other: "Spectrum") -> None:
        """Another spectrum, by an update for each of its vectors and one for the means."""
        for value, vector in zip(other.d, other.u.T):
            if value > 0:
                self.d, self.u = rank_one(self.d, self.u, vector, float(value))
        n = self.n + other.n
        away = other.mean - self.mean
        self.d, self.u = rank_one(self.d, self.u, away, self.n * other.n / n)
        self.mean = self.mean + away * (other.n / n)
        self.high, self.low, self.n = self.high + other.high, self.low + other.low, n

    def sums(self) -> list[int]:
        return [(int(h) << LIMB) + int(k) for h, k in zip(self.high, self.low)]

    def pack(self) -> bytes:
        return b"".join(a.tobytes() for a in (np.array([self.n]), self.high, self.low, self.mean, self.d, self.u))

    @classmethod
    def unpack(cls, raw: bytes, dim: int) -> "Spectrum":
        cut = np.cumsum([1, dim, dim, dim, dim])
        whole = np.frombuffer(raw, np.float64)
        ints = np.frombuffer(raw, np.int64)
        parts = [ints[:1], ints[1:cut[1]], ints[cut[1]:cut[2]], whole[cut[2]:cut[3]], whole[cut[3]:cut[4]], whole[cut[4]:].reshape(dim, dim)]
        return cls(int(parts[0][0]), *[p.copy() for p in parts[1:]])


def vectors_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of each length in a list column."""
    lists = batch.column(column)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, flat[(ends[at] - dim)[:, None] + np.arange(dim)].reshape(len(at), int(dim))


def state_rows(states: dict[int, bytes], group: int) -> Iterator[pa.RecordBatch]:
    for dim, raw in states.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([group], pa.int64()), pa.array([raw], pa.binary())], ["dim", "part", "state"])


def spectrum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, Spectrum] = {}
    for b in batches:
        for _, x in vectors_of(b, 0):
            s = found.setdefault(x.shape[1], Spectrum.empty(x.shape[1]))
            for v in x:
                s.add(v)
    yield from state_rows({dim: s.pack() for dim, s in found.items()}, TaskContext.get().partitionId())


def join_spectra(states: list[bytes], dim: int) -> bytes:
    parts = sorted((Spectrum.unpack(s, dim) for s in states), key=lambda s: -s.n)
    for other in parts[1:]:
        parts[0].join(other)
    return parts[0].pack()


def add_matrices(states: list[bytes], _: int) -> bytes:
    return np.sum([np.frombuffer(s) for s in states], axis=0).tobytes()


def join_moments(states: list[bytes], _: int) -> bytes:
    """Count, mean, centred products."""
    (n, mean, products), *rest = map(moments, states)
    for m, other, more in rest:
        away = other - mean
        products = products + more + np.outer(away, away) * (n * m / (n + m))
        n, mean = n + m, mean + away * (m / (n + m))
    return np.r_[n, mean, products.ravel()].tobytes()


def moments(raw: bytes) -> tuple[float, np.ndarray, np.ndarray]:
    x = np.frombuffer(raw)
    k = int(np.sqrt(4 * len(x) - 3) - 1) // 2  # 1 + k + k * k numbers
    return x[0], x[1:k + 1], x[k + 1:].reshape(k, k)


def combine(states: DataFrame, scratch: Scratch, name: str, join: Callable[[list[bytes], int], bytes]) -> dict[int, bytes]:
    """One state for each length: ``FAN_IN`` states meet in a task, until one is left."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches):
            rows = zip(*(c.to_pylist() for c in g.columns))
            groups: dict[tuple[int, int], list[bytes]] = {}
            for _, dim, part, raw in rows:
                groups.setdefault((dim, part), []).append(raw)
            for (dim, part), raw in groups.items():
                yield from state_rows({dim: join(raw, dim)}, part)

    schema = "dim int, part long, state binary"
    now, k = scratch.write(states, f"{name}-0"), 0
    while now.groupBy("dim").count().filter("count > 1").limit(1).count():
        numbered = now.groupBy("dim").agg(F.sort_array(F.collect_list("part")).alias("parts")).select("dim", F.posexplode("parts").alias("place", "part"))
        groups = now.join(numbered, ["dim", "part"]).select("dim", F.floor(F.col("place") / FAN_IN).cast("long").alias("part"), "state")
        groups = groups.select(F.concat_ws(":", "dim", "part").alias("key"), "dim", "part", "state")
        k += 1
        now = scratch.write(in_batches(groups.repartition("key").sortWithinPartitions("key", F.xxhash64("state")), work, schema), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    return {r["dim"]: bytes(r["state"]) for r in now.collect()}


@dataclass
class Model:
    """What one length of vectors has learnt: eigenvalues fall, ``axes`` has a column for each component."""
    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray, components: int) -> np.ndarray:
        """Coordinates of the first components that have variance."""
        k = min(components, self.rank)
        return ((x - self.mean) @ self.axes[:, :k]) / np.sqrt(self.values[:k])

    @property
    def rank(self) -> int:
        return int((self.values > len(self.values) * EPS * 4 * max(self.values[0], 0)).sum()) if len(self.values) else 0

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum (n x - S)^2 of each row, exactly."""
        n, square = self.n, sum(s * s for s in self.sums)
        high, low = (np.array([f(s) for s in self.sums], object) for f in (lambda s: s >> LIMB, lambda s: s & ((1 << LIMB) - 1)))
        most = int(np.abs(x).max(initial=0))
        if x.shape[1] * most * max(most, 1 << LIMB, *map(abs, high)) < 1 << 63:
            x, high, low = x, high.astype(np.int64), low.astype(np.int64)
        else:
            x = x.astype(object)
        own, cross, rest = (x * x).sum(1).tolist(), (x @ high).tolist(), (x @ low).tolist()
        out = [n * n * a - 2 * n * ((b << LIMB) + c) + square for a, b, c in zip(own, cross, rest)]
        return [v if v < 1 << 63 else None for v in out]


def fit(x: DataFrame, scratch: Scratch, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length among the distinct integer vectors ``x``."""
    state = "dim int, part long, state binary"
    spectra = {dim: Spectrum.unpack(raw, dim) for dim, raw in combine(in_batches(x, spectrum_batches, state), scratch, "whiten-spectra", join_spectra).items()}
    models = {}
    for dim, s in spectra.items():
        sums = s.sums()
        models[dim] = Model(s.n, sums, np.array([v / s.n for v in sums]), s.d[::-1], np.linalg.qr(s.u[:, ::-1])[0])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for _, v in vectors_of(b, 0):
                m = models[v.shape[1]]
                y = (v - m.mean) @ m.axes
                found[v.shape[1]] = found.get(v.shape[1], 0) + y.T @ y
        yield from state_rows({dim: m.tobytes() for dim, m in found.items()}, TaskContext.get().partitionId())

    for dim, raw in combine(in_batches(x, project, state), scratch, "whiten-ritz", add_matrices).items():
        m, b = models[dim], np.frombuffer(raw).reshape(dim, dim)
        values, turn = np.linalg.eigh((b + b.T) / (2 * m.n))
        m.values, m.axes = values[::-1], m.axes @ turn[:, ::-1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, bytes] = {}
        for b in batches:
            for _, v in vectors_of(b, 0):
                w = models[v.shape[1]].whiten(v, components)
                mean = w.mean(0)
                own = np.r_[len(w), mean, ((w - mean).T @ (w - mean)).ravel()].tobytes()
                found[v.shape[1]] = join_moments([found[v.shape[1]], own], 0) if v.shape[1] in found else own
        yield from state_rows(found, TaskContext.get().partitionId())

    for dim, raw in combine(in_batches(x, measure, state), scratch, "whiten-check", join_moments).items():
        n, _, products = moments(raw)
        models[dim].identity_error = float(np.abs(products / n - np.eye(len(products))).max(initial=0.0))
    return models


def transform_batches(models: dict[int, Model], components: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in vectors_of(b, 1):
                m = models[x.shape[1]]
                w = m.whiten(x, components)
                k, trace = w.shape[1], m.values.sum()
                if not k:
                    continue
                deviation = np.repeat(np.array(m.deviations(x), object), k)
                shares = [float(v / trace) for v in m.values[:k]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, m.n)),
                     pa.array(deviation.tolist(), pa.int64()), pa.array(w.ravel()), pa.array(shares * len(at)), pa.array(np.full(len(at) * k, m.identity_error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return work


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each kept row and component: ``id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    scratch = Scratch(vectors.sparkSession)
    entries = F.col(vec_col).cast("array<double>")
    good = entries.isNotNull() & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    rows = vectors.filter(F.coalesce(good, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(entries, lambda c: F.floor(c * SCALE).cast("long")).alias("x")).filter(F.size("x") > 0)
    distinct = scratch.write(rows.select("x").distinct(), "whiten-distinct")
    models = fit(distinct, scratch, components)
    scratch.drop("whiten-distinct")
    return in_batches(rows, transform_batches(models, components),
                      "id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
