"""The batch pipeline from raw tables to published recommendations."""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerrank import fixed_values as fv
from offerrank.catalog import Catalog
from offerrank.operators import explain, ranking, reports
from offerrank.operators.features import FEATURES, FeatureBuilder
from offerrank.operators.learn import OfferModel, split_train_test
from offerrank.operators.rule_tables import RULES_AS_EXPRESSIONS
from offerrank.operators.scoring import training_data
from offerrank.operators.treeshap import explain_trees, feature_vector
from offerrank.session import keep_compiled, materialize, scratch_path
from offerrank.sources.tables import save_serving, write_serving


#: Columns of explained recommendations, whichever scores they come from.
EXPLAINED = ["member_id", "rank", "offer_id", "offer_name", "category", "priority_score", "description", *explain.PROFILE, "top_features"]


class Pipeline:
    """Raw tables, features, scores, recommendations and explanations.

    The feature table is written once and read by every later step, as a table
    of the warehouse would be. Scoring and ranking are projections over that
    table; steps that fit constants (means, quantiles, splits) run small jobs
    while the frame is built.
    """

    def __init__(self, tables: dict[str, DataFrame], reference_ts: datetime,
                 catalog: Catalog | None = None):
        self.tables = tables
        self.reference_ts = reference_ts
        self.catalog = catalog or Catalog()
        self.builder = FeatureBuilder(reference_ts)
        self._explained: tuple = (None, None, None)
        keep_compiled(self.spark)

    @property
    def spark(self) -> SparkSession:
        return self.tables["members"].sparkSession

    @cached_property
    def features(self) -> DataFrame:
        t = self.tables
        built = self.builder.build(t["members"], t["claims"], t["benefits"], t["engagement"])
        return materialize(built, "features")

    @cached_property
    def serving(self) -> DataFrame:
        """The published recommendations in the layout that lookups read.

        Members are dealt out by range before they are ranked and explained:
        that is then done once, and a feature row moves instead of five long ones.
        The ranges are counted, since the work on a row is large for its bytes.
        """
        path = scratch_path(self.spark, "serving")
        tasks = 2 * max(self.spark.sparkContext.defaultParallelism, self.features.rdd.getNumPartitions())
        explained = self._rule_explanations(self.features.repartitionByRange(tasks, "member_id"), 5)
        write_serving(explain.consolidate(explained, self.reference_ts, "demo"), path)
        return self.spark.read.parquet(path)

    def recommendations(self, top_n: int = 5, min_score: float | None = 25.0,
                        exclude_categories: list[str] | None = None) -> DataFrame:
        scored = ranking.with_rule_scores(self.features, self.catalog)
        return ranking.recommend(scored, self.catalog, top_n, min_score, exclude_categories)

    def member_recommendations(self, top_n: int = 5, min_score: float | None = 25.0) -> DataFrame:
        """:meth:`recommendations` as an array ``recs`` in one row per member."""
        scored = ranking.with_rule_scores(self.features, self.catalog)
        return ranking.recommend_in_rows(scored, self.catalog, top_n, min_score).select("member_id", "recs")

    @cached_property
    def tally(self) -> DataFrame:
        """Counts of the recommendations that the summary and the report are made of, written once."""
        return materialize(reports.tally_in_rows(self.member_recommendations(), self.tables["members"]), "tally")

    def explanations(self, k: int = 5, model: OfferModel | None = None) -> DataFrame:
        """Recommendations with factors and the member profile columns, of the rules or of a model."""
        return self._rule_explanations(self.features, k) if model is None else self.tree_explanations(model, k)

    def _rule_explanations(self, features: DataFrame, k: int) -> DataFrame:
        """:meth:`explanations` of the rows of ``features``, row by row where they are."""
        # the rule inputs ride along with the ranked offers: no join, no shuffle
        carried = ["member_id", *dict.fromkeys(
            [*explain.PROFILE, *explain.rule_inputs(self.catalog, self.features.columns)])]
        scored = ranking.with_rule_scores(features, self.catalog)
        recs = ranking.recommend(scored, self.catalog, 5, 25.0, keep=carried)
        return explain.with_rule_factors(recs, self.features, self.catalog, k).select(*EXPLAINED)

    def explained_members(self, k: int = 5) -> DataFrame:
        """:meth:`explanations` with a member's recommendations as an array in one row: no shuffle puts them together."""
        if len(self.catalog.rules) + len(self.catalog.offers) > RULES_AS_EXPRESSIONS:
            rows = self.explanations(k)
            rec = F.struct(*[c for c in EXPLAINED if c not in ("member_id", *explain.PROFILE)])
            return rows.groupBy("member_id", *explain.PROFILE).agg(F.sort_array(F.collect_list(rec)).alias("recs"))
        scored = ranking.with_rule_scores(self.features, self.catalog)
        factors = explain.rule_factors(self.features, self.catalog, k)
        members = ranking.recommend_in_rows(scored, self.catalog, 5, 25.0, factors)
        return members.select("member_id", *explain.PROFILE, "recs")

    def train(self, rounds: int = fv.TREE_SETTINGS["rounds"], depth: int | None = None, noise_sd: float = 0.0) -> OfferModel:
        """Fit the offer models on the training members' rule scores."""
        train, _ = split_train_test(training_data(self.features, self.catalog, noise_sd))
        return OfferModel.fit(train, self.catalog.offer_ids, FEATURES, rounds, depth)

    def model_pairs(self, model: OfferModel) -> DataFrame:
        """The model's recommendations with its inputs ``x`` and the member profile columns."""
        inputs = self.features.withColumn("x", feature_vector(model))
        carried = ["member_id", "x", *explain.PROFILE]
        return ranking.recommend(model.predict(inputs, carried), self.catalog, 5, 25.0, keep=carried)

    def tree_explanations(self, model: OfferModel, k: int = 5) -> DataFrame:
        """Model recommendations with the strongest feature contributions and the member profile columns.

        Written once for the last model that was asked for: publication, export and display read the same rows.
        """
        if self._explained[:2] != (model, k):
            self._explained = (model, k, materialize(explain_trees(model, self.model_pairs(model), k).select(*EXPLAINED), "tree-explanations"))
        return self._explained[2]

    def publish(self, path: str, model: OfferModel | None = None, model_version: str = "demo") -> None:
        """Write the tables that campaigns and lookups read, of the rules or of a model; explanations are made once."""
        explained = materialize(self.explanations(model=model), "explained")
        consolidated = materialize(explain.consolidate(explained, self.reference_ts, model_version), "consolidated")
        save_serving(consolidated, f"{path}/consolidated")
        explained.drop(*explain.PROFILE, "top_features").write.mode("overwrite").parquet(f"{path}/recommendations")
        ranking.campaign_offers(consolidated).write.mode("overwrite").parquet(f"{path}/campaign")
        explain.nested_export(explained).write.mode("overwrite").json(f"{path}/members")

    def consolidated(self, model: OfferModel | None = None, model_version: str = "demo") -> DataFrame:
        return explain.consolidate(self.explanations(model=model), self.reference_ts, model_version)

    def offer_means(self, by: list[str] = ()) -> DataFrame:
        """Rule scores (y) with the mean score of the offer, or of the offer and
        further feature columns, as a naive prediction (p)."""
        y = ranking.with_rule_scores(self.features, self.catalog).select(
            "member_id", *by, F.inline("scores")).withColumnRenamed("score", "y").drop("turn", "ord")
        means = y.groupBy("offer_id", *by).agg(F.avg("y").alias("p"))
        # as few means as offers times feature values; written, so that their size is known and they are broadcast
        return y.join(materialize(means, "offer-means"), ["offer_id", *by]).select(
            "member_id", "offer_id", "y", "p")
