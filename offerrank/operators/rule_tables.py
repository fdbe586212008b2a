"""Rule scores of catalogs of any size.

The rules of an offer on a feature are a sorted array of thresholds with running
boosts: ``min`` rules from below, ``max`` rules from above, ``scale`` rules as one
factor. A row finds its place by binary search, so an offer's score takes one
search for each feature it looks at, however many rules there are. The tables
are as long as the catalog, which the driver holds anyway, and go to the
executors once. A missing value (null or NaN) meets no threshold and scales to 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from offerrank.catalog import Catalog
from offerrank.functions.scalar import round_even
from offerrank.session import ship_package

RULES_AS_EXPRESSIONS = 400


class RuleTables:
    def __init__(self, catalog: Catalog, columns: list[str]):
        features = {name: Catalog.feature_of(name, columns) for name in {r.name for r in catalog.rules}}
        place = {offer_id: k for k, offer_id in enumerate(catalog.offer_ids)}
        rules = [(place[r.offer_id], features[r.name], r) for r in catalog.rules if r.offer_id in place and features[r.name] is not None]
        rules.sort(key=lambda x: x[0])  # of one offer they stay in the catalog's order
        self.inputs = list(dict.fromkeys(f for _, f, _ in rules))
        at = {f: k for k, f in enumerate(self.inputs)}
        self.offer_ids = catalog.offer_ids
        self.base = np.array([float(o.base_score) for o in catalog.offers])
        self.offer = np.array([o for o, _, _ in rules], int)
        self.feature = np.array([at[f] for _, f, _ in rules], int)
        self.kind = np.array([{"min": 0, "max": 1}.get(r.kind, 2) for _, _, r in rules], int)
        self.threshold = np.array([np.nan if r.threshold is None else float(r.threshold) for _, _, r in rules])
        self.boost = np.array([float(r.boost) for _, _, r in rules])

    def searches(self) -> list[tuple]:
        """(offer, feature, kind, thresholds, running boosts) of each offer and feature; a ``scale`` entry has its factor."""
        order = np.lexsort((self.threshold, self.kind, self.feature, self.offer))
        keys = np.stack([self.offer, self.feature, self.kind], 1)[order]
        starts = np.flatnonzero(np.r_[True, (np.diff(keys, axis=0) != 0).any(1)]) if len(keys) else []
        found = []
        for s, e in zip(starts, [*starts[1:], len(keys)]):
            kind, boosts = int(keys[s, 2]), self.boost[order[s:e]]
            running = np.r_[0.0, np.cumsum(boosts)] if kind == 0 else np.r_[np.cumsum(boosts[::-1])[::-1], 0.0]
            found.append((int(keys[s, 0]), int(keys[s, 1]), kind, self.threshold[order[s:e]], boosts.sum() if kind == 2 else running))
        return found

    def values(self, df: DataFrame):
        return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.inputs]).cast("array<double>")

    def with_totals(self, features: DataFrame, name: str) -> DataFrame:
        """``features`` with the unclipped scores of all offers, in catalog order, as an array."""
        ship_package(features.sparkSession)
        shared, base, width = features.sparkSession.sparkContext.broadcast(self.searches()), self.base, len(self.inputs)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(b.num_columns - 1).flatten().to_numpy().reshape(b.num_rows, width)
                missing, totals = np.isnan(x), np.tile(base, (b.num_rows, 1))
                for offer, f, kind, thresholds, running in shared.value:
                    v = x[:, f]
                    if kind == 2:
                        add = np.where(missing[:, f], 0.0, v * running)
                    else:  # v >= threshold, or v <= threshold
                        add = np.where(missing[:, f], 0.0, running[np.searchsorted(thresholds, v, side="right" if kind == 0 else "left")])
                    totals[:, offer] += add
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(base)), pa.array(totals.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], [*b.schema.names[:-1], name])

        given = features.withColumn(name, self.values(features))
        return given.mapInArrow(work, given.schema)

    def means(self, features: DataFrame) -> np.ndarray:
        """Mean boost of each rule over the members: values are counted between the thresholds of a feature, in one aggregate."""
        ship_package(features.sparkSession)
        width = len(self.inputs)
        cuts = {(f, kind): np.unique(self.threshold[(self.feature == f) & (self.kind == kind)]) for f in range(width) for kind in (0, 1)}
        shared = features.sparkSession.sparkContext.broadcast(cuts)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, width)
                for f in range(width):
                    v = x[:, f][~np.isnan(x[:, f])]
                    parts = {2: np.array([v.sum(), b.num_rows])}
                    for kind, side in ((0, "right"), (1, "left")):
                        parts[kind] = np.bincount(np.searchsorted(shared.value[f, kind], v, side=side), minlength=len(shared.value[f, kind]) + 1).astype(float)
                    for kind, n in parts.items():
                        found[f, kind] = found.get((f, kind), 0) + n
            for (f, kind), n in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([kind]), pa.array([n.tolist()])], ["feature", "kind", "n"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for f, kind, n in zip(*(c.to_pylist() for c in b.columns)):
                    found[f, kind] = found.get((f, kind), 0) + np.array(n)
            for (f, kind), n in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([kind]), pa.array([n.tolist()])], ["feature", "kind", "n"])

        schema = "feature long, kind long, n array<double>"
        counted = features.select(self.values(features)).mapInArrow(count, schema).repartition("feature", "kind").mapInArrow(add, schema)
        sums = {(r["feature"], r["kind"]): np.array(r["n"]) for r in counted.collect()}
        out = np.zeros(len(self.boost))
        for f in range(width):
            if (f, 2) not in sums:
                continue
            total, members = sums[f, 2]
            for kind in (0, 1, 2):
                at = np.flatnonzero((self.feature == f) & (self.kind == kind))
                if kind == 2:
                    share = total / members
                else:
                    n = sums[f, kind]
                    meeting = np.cumsum(n[::-1])[::-1][1:] if kind == 0 else np.cumsum(n)[:-1]
                    share = meeting[np.searchsorted(cuts[f, kind], self.threshold[at])] / members
                out[at] = self.boost[at] * share
        return out

    def with_factors(self, pairs: DataFrame, means: np.ndarray, k: int) -> DataFrame:
        """``pairs`` with ``top_features``: each rule's boost less its mean, strongest first, then by feature name."""
        ship_package(pairs.sparkSession)
        ends = np.searchsorted(self.offer, np.arange(len(self.offer_ids) + 1))
        name_order = np.argsort(np.argsort(self.inputs)) if self.inputs else np.zeros(0, int)
        tables = {"span": {o: (int(ends[i]), int(ends[i + 1])) for i, o in enumerate(self.offer_ids)}, "means": means, "feature": self.feature, "kind": self.kind,
                  "threshold": self.threshold, "boost": self.boost, "order": name_order}
        shared, width = pairs.sparkSession.sparkContext.broadcast(tables), len(self.inputs)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = shared.value
            for b in batches:
                x = b.column(b.num_columns - 1).flatten().to_numpy().reshape(b.num_rows, width)
                offers = b["offer_id"].to_numpy(zero_copy_only=False)
                found: list[tuple] = [([], [], [])] * b.num_rows
                for offer in set(offers.tolist()):
                    s, e = t["span"].get(offer, (0, 0))
                    if s == e:
                        continue
                    rows, f = np.flatnonzero(offers == offer), t["feature"][s:e]
                    for part in np.array_split(rows, -(-len(rows) * (e - s) // 4_000_000)):
                        v = x[part][:, f]
                        with np.errstate(invalid="ignore"):
                            holds = np.where(t["kind"][s:e] == 0, v >= t["threshold"][s:e], v <= t["threshold"][s:e])
                        gain = np.where(t["kind"][s:e] == 2, np.where(np.isnan(v), 0.0, v), holds) * t["boost"][s:e] - t["means"][s:e]
                        best = np.lexsort((np.broadcast_to(t["order"][f], gain.shape), -np.abs(gain)), axis=1)[:, :k]
                        for i, at in zip(part, best):
                            r = np.searchsorted(part, i)
                            found[i] = (f[at].tolist(), [None if np.isnan(c) else c for c in v[r, at].tolist()], gain[r, at].tolist())
                at, value, phi = ([row[c] for row in found] for c in range(3))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float64())), pa.array(phi, pa.list_(pa.float64()))],
                                                 [*b.schema.names[:-1], "_at", "_value", "_phi"])

        given = pairs.withColumn("_x", self.values(pairs))
        numbers = ArrayType(DoubleType())
        schema = StructType([*given.schema.fields[:-1], StructField("_at", ArrayType(IntegerType())), StructField("_value", numbers), StructField("_phi", numbers)])
        names = F.array(*map(F.lit, self.inputs)).cast("array<string>")
        factors = F.transform(F.arrays_zip("_at", "_value", "_phi"), lambda z: F.struct(
            F.element_at(names, z["_at"] + 1).alias("feature"), round_even(z["_value"], 2).alias("value"),
            (round_even(z["_phi"], 3) + 0.0).alias("shap_value"), F.when(z["_phi"] > 0, "increases").otherwise("decreases").alias("direction")))
        return given.mapInArrow(work, schema).withColumn("top_features", factors).drop("_at", "_value", "_phi")
