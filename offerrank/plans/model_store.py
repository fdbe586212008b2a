"""Models under version numbers, with aliases that move in one step."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerrank.operators import feedback
from offerrank.operators.feedback import METRICS_SCHEMA
from offerrank.operators.learn import OfferModel
from offerrank.plans.retraining import Challenger, retrain
from offerrank.plans.workspace import Pipeline
from offerrank.sources import files

METRICS = ["rmse", "mae", "r2"]


class AliasMoved(RuntimeError):
    """Somebody else moved the alias since it was looked up."""


class ModelStore:
    """Versions and aliases in a folder that all sessions share.

    A model is written beside the versions and then renamed to the next free
    number, so a version that exists is complete, a writer that dies leaves none,
    and two writers get two numbers. Each move of an alias is a numbered entry,
    claimed in the same way; the last entry holds. A reader therefore sees the
    old champion or the new one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _version_path(self, version: int) -> str:
        return f"{self.folder}/versions/{version}"

    def versions(self) -> list[int]:
        return files.numbered(self.spark, f"{self.folder}/versions")

    def save(self, model: OfferModel, metrics: dict[str, float] | None = None) -> int:
        """Store a model and its held-out metrics; the result is its version."""
        staged = files.incoming(f"{self.folder}/versions")
        model.save(staged)
        known = {m: (metrics or {}).get(m) for m in METRICS}
        self.spark.createDataFrame([(json.dumps(known),)], "value STRING").coalesce(1).write.text(f"{staged}/metrics")
        version = max(self.versions(), default=0) + 1
        while not files.claim(self.spark, staged, self._version_path(version)):
            version += 1
        return version

    def _moves(self, alias: str) -> list[int]:
        return files.numbered(self.spark, f"{self.folder}/aliases/{alias}")

    def version_of(self, alias: str) -> int | None:
        """The version an alias points to; None if it was never set or was taken away."""
        moves = self._moves(alias)
        if not moves:
            return None
        value = self.spark.read.text(f"{self.folder}/aliases/{alias}/{moves[-1]}").first()["value"]
        return int(value) if value else None

    def set_alias(self, alias: str, version: int | None, *, expected: int | None | str = "any") -> None:
        """Point an alias to a stored version, or to none.

        With ``expected`` (a version or None) the alias only moves if it still
        points there; otherwise :class:`AliasMoved` is raised and it stays.
        """
        if version is not None and not files.exists(self.spark, self._version_path(version)):
            raise KeyError(f"no version {version} in {self.folder}")
        folder = f"{self.folder}/aliases/{alias}"
        staged = files.incoming(folder)
        self.spark.createDataFrame([("" if version is None else str(version),)], "value STRING").coalesce(1).write.text(staged)
        while True:
            last = max(self._moves(alias), default=0)  # read before the comparison: a later move takes the next number
            if expected != "any" and self.version_of(alias) != expected:
                files.remove(self.spark, staged)
                raise AliasMoved(f"{alias} no longer points to {expected}")
            if files.claim(self.spark, staged, f"{folder}/{last + 1}"):
                return

    def load(self, which: int | str = "champion") -> OfferModel:
        """The model of a version or an alias."""
        version = self.version_of(which) if isinstance(which, str) else which
        if version is None or not files.exists(self.spark, self._version_path(version)):
            raise KeyError(f"no model {which} in {self.folder}")
        return OfferModel.load(self._version_path(version))

    def table(self, aliases: tuple[str, ...] = ("champion", "challenger")) -> DataFrame:
        """The versions with their metrics and alias, as the comparison of models takes them; the first alias named wins."""
        named = {self.version_of(a): a for a in reversed(aliases)}
        paths = {v: f"{self._version_path(v)}/metrics" for v in self.versions()}
        rows = []
        for version, path in paths.items():  # a few numbers for each version
            known = json.loads(self.spark.read.text(path).first()["value"])
            rows.append((version, named.get(version), *[known[m] for m in METRICS]))
        return self.spark.createDataFrame(rows, METRICS_SCHEMA)

    def retrain(self, p: Pipeline, all_feedback: DataFrame, **settings) -> tuple[Challenger, int] | None:
        """Train, store and compare a challenger; make it the champion if it is better.

        None when there is too little feedback. The champion only moves from the
        one that was compared with.
        """
        champion = self.version_of("champion")
        outcome = retrain(p, all_feedback, self.table(), **settings)
        if outcome is None:
            return None
        challenger, _ = outcome
        metrics = challenger.metrics.select(*METRICS).first().asDict()
        version = self.save(challenger.model, metrics)
        self.set_alias("challenger", version)
        compared = self.table(("challenger", "champion"))
        if feedback.compare_models(compared).where(F.col("challenger_is_better")).count():
            self.set_alias("champion", version, expected=champion)
            self.set_alias("challenger", None, expected=version)
        return challenger, version
