"""Boosted-tree models, one per offer, trained together."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from offerrank import fixed_values as fv
from offerrank.functions.scalar import clip_score
from offerrank.operators.boosting import feature_array, fit, leaf_of_columns
from offerrank.operators.quantiles import first_by_hash
from offerrank.operators.scoring import score_array
from offerrank.session import ship_package

NODE_SCHEMA = ("ord INT, tree INT, weight DOUBLE, id INT, value DOUBLE, rows DOUBLE, left INT, right INT, "
               "feature INT, threshold DOUBLE")


def split_train_test(df: DataFrame, test_share: float = 0.2, seed: str = "42") -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly ceil(share * n) test rows, chosen by hashed member.

    The choice depends on nothing but member and seed, so it repeats on any
    cluster. Split members before oversampling them, or copies leak.
    """
    marked = first_by_hash(df, "member_id", test_share, seed)
    return (marked.where(~F.col("is_first")).drop("is_first"),
            marked.where(F.col("is_first")).drop("is_first"))


class OfferModel:
    """One boosted regressor per offer over the same feature vector.

    Trees do not depend on the scale of a feature, so features are not scaled.
    The model is its table of nodes: offers times rounds times leaves, which
    the settings fix, not the data. The first tree of an offer is its mean.
    """

    def __init__(self, offer_ids: list[str], feature_names: list[str], nodes: pd.DataFrame, settings: dict):
        self.offer_ids = offer_ids
        self.feature_names = feature_names
        self.nodes = nodes
        self.settings = settings

    @classmethod
    def fit(cls, data: DataFrame, offer_ids: list[str], feature_names: list[str],
            rounds: int = fv.TREE_SETTINGS["rounds"], depth: int | None = None, weight_col: str | None = None,
            leaves: int = fv.TREE_SETTINGS["leaves"], seed: int = fv.TREE_SETTINGS["seed"]) -> "OfferModel":
        """``data`` holds the features and a ``score_<offer>`` column per offer.

        Trees have up to ``leaves`` leaves, of at most ``depth`` splits above
        each when it is given.
        """
        ship_package(data.sparkSession)
        fitted = fit(data, feature_names, [f"score_{o}" for o in offer_ids], rounds, leaves, fv.TREE_SETTINGS["learning_rate"],
                     fv.TREE_SETTINGS["row_fraction"], fv.TREE_SETTINGS["feature_fraction"], seed, "member_id", weight_col, depth)
        nodes = pd.DataFrame(list(fitted.nodes()), columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])
        settings = {"rounds": rounds, "leaves": leaves, "depth": depth, "seed": seed, "weight_col": weight_col}
        return cls(offer_ids, feature_names, nodes, settings)

    @cached_property
    def forests(self) -> list[list[tuple]]:
        """For each offer its trees as arrays, with the value of each node times the tree's weight."""
        n = self.nodes.sort_values(["ord", "tree", "id"])
        columns = {c: n[c].to_numpy() for c in ("ord", "tree", "feature", "left", "right")}
        threshold, value = n["threshold"].fillna(0).to_numpy(float), (n["value"] * n["weight"]).to_numpy()
        starts = np.flatnonzero(np.r_[True, (np.diff(columns["tree"]) != 0) | (np.diff(columns["ord"]) != 0)])
        out: list[list[tuple]] = [[] for _ in self.offer_ids]
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(n)]):
            left, right = columns["left"][s:e], columns["right"][s:e]
            deep = [0] * (e - s)
            for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
                if a >= 0:  # children come after their parent
                    deep[a] = deep[b] = deep[i] + 1
            out[columns["ord"][s]].append(((columns["feature"][s:e], threshold[s:e], left, right, max(deep)), value[s:e]))
        return out

    def with_predictions(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns plus the array ``_pred`` of unclipped predictions, in Arrow batches."""
        ship_package(df.sparkSession)
        width, shared = len(self.feature_names), df.sparkSession.sparkContext.broadcast(self.forests)  # the settings bound its size

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(b.num_columns - 1).flatten().to_numpy().reshape(-1, width)
                pred, columns = np.zeros((len(x), len(shared.value))), np.ascontiguousarray(x.T)
                for k, trees in enumerate(shared.value):
                    for arrays, value in trees:
                        pred[:, k] += value[leaf_of_columns(columns, *arrays)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * pred.shape[1]), pa.array(pred.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], [*b.schema.names[:-1], "_pred"])

        given = df.select(*keep, feature_array(self.feature_names).alias("_x"))
        return given.mapInArrow(work, StructType([*given.schema.fields[:-1], StructField("_pred", ArrayType(DoubleType()))]))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with a ``pred_<offer>`` column per offer."""
        predicted = self.with_predictions(df, df.columns)
        return predicted.select(*df.columns, *[F.col("_pred")[k].alias(f"pred_{o}") for k, o in enumerate(self.offer_ids)])

    def predict(self, features: DataFrame, keep: list[str] = ("member_id",)) -> DataFrame:
        """``keep`` columns plus the array of clipped ``scores`` used for ranking."""
        scores = {o: clip_score(F.col("_pred")[k]) for k, o in enumerate(self.offer_ids)}
        return self.with_predictions(features, list(keep)).select(*keep, score_array(scores).alias("scores"))

    def tree_nodes(self, spark: SparkSession) -> DataFrame:
        """All tree nodes as rows of (ord, tree, weight, id, value, rows, left,
        right, feature, threshold); feature is -1 in a leaf."""
        kinds = {"INT": pa.int32(), "DOUBLE": pa.float64()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in NODE_SCHEMA.split(", ")])
        return spark.createDataFrame(pa.Table.from_pandas(self.nodes, schema, preserve_index=False))

    def feature_importance(self, spark: SparkSession) -> DataFrame:
        """Mean number of splits per model for every feature, largest first."""
        splits = self.nodes.loc[self.nodes["feature"] >= 0, "feature"].value_counts()
        rows = [(name, int(splits.get(k, 0)) / len(self.offer_ids)) for k, name in enumerate(self.feature_names)]
        return spark.createDataFrame(rows, "feature STRING, importance DOUBLE").orderBy(F.desc("importance"), "feature")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.tree_nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = json.dumps({"offer_ids": self.offer_ids, "feature_names": self.feature_names,
                           "settings": self.settings})
        spark.createDataFrame([(meta,)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> "OfferModel":
        spark = SparkSession.active()
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("ord", "tree", "id").toPandas()
        return cls(meta["offer_ids"], meta["feature_names"], nodes, meta["settings"])


def prediction_pairs(model: OfferModel, data: DataFrame) -> DataFrame:
    """Long (member_id, offer_id, y, p) of a frame that holds the targets."""
    targets = [f"score_{o}" for o in model.offer_ids]
    pairs = [F.struct(F.lit(o).alias("offer_id"), F.col(f"score_{o}").alias("y"),
                      clip_score(F.col("_pred")[k]).alias("p")) for k, o in enumerate(model.offer_ids)]
    return model.with_predictions(data, ["member_id", *targets]).select("member_id", F.inline(F.array(*pairs)))


def _error_sums(pairs: DataFrame) -> DataFrame:
    error = F.col("y") - F.col("p")
    return pairs.groupBy("offer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(error * error).alias("sse"), F.sum(F.abs(error)).alias("sae"),
        (F.var_pop("y") * F.count(F.lit(1))).alias("sst"))


def regression_metrics(pairs: DataFrame) -> DataFrame:
    """Pooled rmse and mae, r2 averaged over offers, mean rmse per offer."""
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(
        F.when(F.col("sse") == 0, 1.0).otherwise(0.0))
    return _error_sums(pairs).agg(
        F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"), (F.sum("sae") / F.sum("n")).alias("mae"),
        F.avg(r2).alias("r2"), F.avg(F.sqrt(F.col("sse") / F.col("n"))).alias("avg_rmse_per_offer"))


def rmse_by_offer(pairs: DataFrame) -> DataFrame:
    return _error_sums(pairs).select(
        "offer_id", F.sqrt(F.col("sse") / F.col("n")).alias("rmse")).orderBy("rmse", "offer_id")
