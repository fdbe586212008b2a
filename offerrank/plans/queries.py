"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerrank import fixed_values as fv
from offerrank.functions.scalar import bin_label, safe_bool, safe_float, safe_int
from offerrank.functions.text import member_text, offer_prompt, summary_prompt
from offerrank.operators import explain, features, feedback, learn, profile, quality, ranking, reports, scoring, treeshap
from offerrank.operators.segments import member_segments, segment_summary
from offerrank.plans.retraining import train_challenger
from offerrank.plans.workspace import Pipeline
from offerrank.session import materialize, scratch_path, ship_package
from offerrank.sources import tables
from offerrank.sources.fixtures import FEEDBACK_SQL, MEMBERS_SQL, REFERENCE_TS, VIEWS, fixture
from offerrank.streaming import jobs

TIE_SHIFT = 2.5e-8
LOOKUP_MEMBER = "MBR_00000042"

_pipelines: dict[tuple[str, str], Pipeline] = {}
_models: dict[tuple[str, str], learn.OfferModel] = {}


def reset() -> None:
    """Forget the feature tables and models of earlier queries."""
    _pipelines.clear()
    _models.clear()


def _key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, sf_dir


def pipeline(spark: SparkSession, sf_dir: str) -> Pipeline:
    """The pipeline of this session and folder; queries share its feature table."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if _key(spark, sf_dir) not in _pipelines:
        ship_package(spark)
        inputs = {view: fixture(spark, sf_dir, view) for view in VIEWS}
        _pipelines[_key(spark, sf_dir)] = Pipeline(inputs, REFERENCE_TS)
    return _pipelines[_key(spark, sf_dir)]


def _training(p: Pipeline) -> DataFrame:
    return scoring.training_data(p.features, p.catalog)


def _model(p: Pipeline) -> learn.OfferModel:
    key = next(k for k, v in _pipelines.items() if v is p)
    if key not in _models:
        _models[key] = p.train()
    return _models[key]


# --- output shaping: doubles rounded, times as text, flags as integers --------
def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, so that summation order does not show in the last bits.

    Means of amounts often end in a 5 just behind the last digit; the small
    shift keeps such ties from falling either way.
    """
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.col(c) + F.lit(TIE_SHIFT), digits) + F.lit(0.0) for c in doubles})


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    shaped = {}
    for f in df.schema:
        if f.dataType.typeName() == "timestamp":
            shaped[f.name] = F.date_format(f.name, "yyyy-MM-dd HH:mm:ss")
        elif f.dataType.typeName() == "boolean":
            shaped[f.name] = F.col(f.name).cast("int")
    return rounded(df.withColumns(shaped), digits)


def factor_rows(explained: DataFrame) -> DataFrame:
    return explained.select("member_id", "offer_id", "rank", F.posexplode("top_features").alias("_i", "f")).select(
        "member_id", "offer_id", "rank", (F.col("_i") + 1).alias("factor_rank"), "f.*")


# --- queries that need more than one expression -------------------------------
def value_share(p: Pipeline) -> DataFrame:
    t = p.tables
    parts = [profile.value_shares(t["members"], ["gender", "region", "plan_type"]),
             profile.value_shares(t["claims"], ["claim_type"]),
             profile.value_shares(t["engagement"], ["channel", "engagement_type"])]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def safe_casts(p: Pipeline) -> DataFrame:
    """The three casts over order keys turned into good and bad texts."""
    key = F.col("feedback_id")
    text = (F.when(key % 7 == 0, F.lit(None).cast("string")).when(key % 7 == 1, "yes").when(key % 7 == 2, "TRUE")
            .when(key % 7 == 3, "n/a").when(key % 7 == 4, key.cast("string"))
            .when(key % 7 == 5, F.concat(F.lit("-"), key.cast("string"), F.lit(".75"))).otherwise("1"))
    return p.tables["feedback"].select("feedback_id", text.alias("raw")).select(
        "feedback_id", safe_float(F.col("raw")).alias("as_float"), safe_int(F.col("raw")).alias("as_int"),
        safe_bool(F.col("raw")).cast("int").alias("as_bool"))


def validate_members_query(p: Pipeline) -> DataFrame:
    """Members with repeated and missing ids mixed in, checked for a column too many."""
    m = p.tables["members"]
    dirty = m.unionByName(m.where("age = 40")).unionByName(
        m.where("age = 30").withColumn("member_id", F.lit(None).cast("string")))
    return quality.validate_members(dirty, ["member_id", "age", "email"])


def raw_features(p: Pipeline) -> DataFrame:
    """The features before filling, as the feature job has written them."""
    p.features
    return p.builder.raw


def validate_features_query(p: Pipeline) -> DataFrame:
    """Unfilled features plus a column with infinities, one expected name missing."""
    odd = F.when(F.col("age") == 40, F.lit(float("inf"))).otherwise(F.col("risk_score"))
    checked = raw_features(p).withColumn("cost_ratio", odd)
    return quality.validate_features(checked, [*checked.columns, "remaining_oop_max_pct"])


def drift_query(p: Pipeline) -> DataFrame:
    baseline = profile.monitor_stats(p.features, features.FEATURES)
    current = profile.monitor_stats(p.features.where("age >= 40"), features.FEATURES)
    return quality.check_drift(baseline, current)


def recs_enriched(p: Pipeline) -> DataFrame:
    """Feedback offers looked up in the catalog; every 31st one is of an offer that it does not have."""
    offer = F.when(F.col("feedback_id") % 31 == 0, F.lit("OLD_001")).otherwise(F.col("offer_id"))
    return ranking.enrich(p.tables["feedback"].select("feedback_id", offer.alias("offer_id")), p.catalog)


def feedback_append(p: Pipeline) -> DataFrame:
    """Two appends to an empty feedback log, then the log."""
    path = scratch_path(p.spark, "feedback-log")
    for kinds in (["approved", "rejected"], ["comment"]):
        tables.append_feedback(p.tables["feedback"].where(F.col("feedback").isin(kinds)), path)
    return p.spark.read.schema(tables.SCHEMAS["feedback"]).parquet(path)


def train_test(p: Pipeline) -> DataFrame:
    train, test = learn.split_train_test(p.features.select("member_id"), seed="")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def label_encode(p: Pipeline) -> DataFrame:
    p.features  # the encoders are fitted with the feature table
    return p.builder.encoders.codes


def model_versions(p: Pipeline) -> DataFrame:
    """Metrics of two naive predictors as versions 1 (champion) and 2 (challenger)."""
    rows = [learn.regression_metrics(p.offer_means(by)).select(
        F.lit(version).alias("version"), F.lit(alias).alias("alias"), "rmse", "mae", "r2")
        for version, alias, by in ((1, "champion", []), (2, "challenger", ["is_senior", "has_diabetes"]))]
    return rows[0].unionByName(rows[1])


def gbt_train_metrics(p: Pipeline) -> DataFrame:
    model, (train, test) = _model(p), learn.split_train_test(_training(p))
    parts = [learn.regression_metrics(learn.prediction_pairs(model, df)).select(F.lit(name).alias("part"), "*")
             for name, df in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1])


def gbt_recommendations(p: Pipeline) -> DataFrame:
    return ranking.recommend(_model(p).predict(p.features), p.catalog, 5, 25.0)


def adjusted_scores(p: Pipeline) -> DataFrame:
    return feedback.adjust_targets(scoring.rule_scores(p.features, p.catalog),
                                   feedback.decided(p.tables["feedback"]))


def gbt_checks(p: Pipeline) -> DataFrame:
    """Members whose ranks have gaps or whose scores rise with rank, and scores out of range: none."""
    written = materialize(gbt_recommendations(p), "model-recommendations")  # checked as published
    by_member = written.groupBy("member_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "priority_score"))).alias("r"))
    gap = F.exists(F.sequence(F.lit(1), F.size("r")), lambda i: F.get("r", i - 1)["rank"] != i)
    rises = F.exists(F.sequence(F.lit(1), F.size("r")), lambda i: F.coalesce(F.get("r", i)["priority_score"] > F.get("r", i - 1)["priority_score"], F.lit(False)))
    off = F.exists("r", lambda s: ~s["priority_score"].between(25, 100))
    return by_member.agg(*[F.count_if(c).alias(n) for n, c in (("gaps", gap), ("rises", rises), ("out_of_range", off))])


def tree_bases(p: Pipeline, model: learn.OfferModel) -> DataFrame:
    """What the contributions leave of each recommended pair's prediction, as (offer_id, base).

    A member's predictions stay an array in one row. Their size is guessed from the few columns, far too
    small, and as a broadcast all of them would pass through the driver; so the join is told to sort.
    """
    pairs = treeshap.explain_trees(model, p.model_pairs(model), total="explained").select("member_id", "offer_id", "explained")
    pred = model.with_predictions(p.features, ["member_id"])
    place = F.array_position(F.array(*map(F.lit, model.offer_ids)), F.col("offer_id")).cast("int")
    return pairs.join(pred.hint("merge"), "member_id").select("offer_id", (F.get("_pred", place - 1) - F.col("explained")).alias("base"))


def tree_additivity(p: Pipeline) -> DataFrame:
    """Recommended pairs whose contributions and the offer's base do not add up to the prediction: none."""
    base = materialize(tree_bases(p, _model(p)), "tree-bases")  # needed twice, and costly
    spread = base.groupBy("offer_id").agg(F.min("base").alias("low"), F.max("base").alias("high"))
    return base.join(spread, "offer_id").agg(F.count_if((F.col("base") - F.col("low") > 1e-6) | (F.col("high") - F.col("base") > 1e-6)).alias("off"))


def challenger_metrics(p: Pipeline) -> DataFrame:
    """Retrain on adjusted targets with feedback members repeated in training."""
    given = feedback.decided(p.tables["feedback"])
    return train_challenger(p, given).metrics


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return tables.normalize_timestamps(stream)


def stream_feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipeline(spark, sf_dir)
    events = spark.sql(FEEDBACK_SQL, orders=_stream(spark, sf_dir, "orders"))
    return plain(jobs.run_feedback_counts(events, scratch_path(spark, "feedback-counts"), scratch_path(spark, "counts-state")))


def stream_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pipeline(spark, sf_dir)
    static = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region")}
    requests = spark.sql(MEMBERS_SQL, customer=_stream(spark, sf_dir, "customer"), **static)
    return jobs.run_recommendations(requests, p.features, scratch_path(spark, "live-recs"), scratch_path(spark, "recs-state"))


def member_prompts(p: Pipeline) -> DataFrame:
    return p.explanations().select("member_id", "offer_id", offer_prompt().alias("prompt"))


def member_texts(p: Pipeline) -> DataFrame:
    return p.explained_members().select("member_id", member_text(F.col("recs")).alias("text"))


def summary_prompts(p: Pipeline) -> DataFrame:
    nested = explain.nested_in_rows(p.explained_members())
    as_json = F.to_json(F.struct("member_id", "profile", "recommendations"))
    return nested.select("member_id", summary_prompt(as_json).alias("prompt"))


def member_export(p: Pipeline) -> DataFrame:
    return member_lines(explain.nested_in_rows(p.explained_members()))


def member_lines(nested: DataFrame) -> DataFrame:
    """The nested export, one text per recommendation list for comparison."""
    lines = F.transform("recommendations", lambda r: F.concat_ws(
        "|", r["rank"].cast("string"), r["offer_id"], F.size(r["key_factors"]).cast("string")))
    return nested.select("member_id", "profile.*", F.array_join(lines, ";").alias("offers"))


def factors_roundtrip(p: Pipeline) -> DataFrame:
    """Factors to JSON and back; the text of one member in ten is broken on purpose."""
    text = F.when(F.col("member_id").endswith("7"), F.lit("{broken")).otherwise(F.col("shap_factors"))
    parsed = p.consolidated().select("member_id", "offer_id", explain.parse_factors(text).alias("f"))
    return parsed.select("member_id", "offer_id", F.size("f").alias("n_factors"),
                         F.get("f", F.lit(0))["feature"].alias("first_feature"),
                         F.aggregate("f", F.lit(0.0), lambda a, x: a + x["shap_value"]).alias("total"))


def profile_of_member(p: Pipeline) -> DataFrame:
    found = reports.member_profile(LOOKUP_MEMBER, p.features, p.recommendations())
    lost = reports.member_profile("MBR_UNKNOWN", p.features, p.recommendations())
    both = found.unionByName(lost)
    return both.select("member_id", "features.*", "error",
                       F.array_join(F.col("recommendations.offer_id"), ",").alias("offers"))


def _simple() -> dict[str, Callable[[Pipeline], DataFrame]]:
    """Queries that are one call on the pipeline."""
    fx = features.FEATURES
    return {
        # scans and reads
        "scan_members": lambda p: p.tables["members"],
        "scan_claims": lambda p: p.tables["claims"],
        "scan_benefits": lambda p: p.tables["benefits"],
        "scan_engagement": lambda p: p.tables["engagement"],
        "feedback_load": lambda p: feedback.load_feedback(p.tables["feedback"]),
        "feedback_append": feedback_append,
        "export_json": lambda p: reports.json_rows(p.recommendations()),
        "search_members": lambda p: reports.search_members(p.serving, "0001"),
        "list_members": lambda p: reports.list_members(p.serving),
        "member_lookup": lambda p: reports.member_recommendations(p.serving, LOOKUP_MEMBER),
        "sample_members": lambda p: reports.sample_members(p.features.select("member_id"), 100),
        # scalar work
        "age_group": lambda p: p.tables["members"].select(
            "member_id", "age", bin_label(F.col("age"), fv.AGE_BINS, fv.AGE_LABELS).alias("age_group")),
        "tenure_group": lambda p: p.tables["members"].select(
            "member_id", "tenure_months",
            bin_label(F.col("tenure_months"), fv.TENURE_BINS, fv.TENURE_LABELS).alias("tenure_group")),
        "safe_casts": safe_casts,
        # features
        "features_demographic": lambda p: p.features.select("member_id", *features.DEMOGRAPHIC),
        "features_claims": lambda p: features.claim_features(
            p.tables["claims"], p.reference_ts).select("member_id", *features.CLAIMS),
        "features_diagnosis": lambda p: features.claim_features(
            p.tables["claims"], p.reference_ts).select("member_id", *features.DIAGNOSIS),
        "features_benefits": lambda p: features.benefit_features(p.tables["benefits"], p.reference_ts),
        "features_engagement": lambda p: features.engagement_features(
            p.tables["engagement"], p.reference_ts).drop("preferred_channel"),
        "preferred_channel": lambda p: features.engagement_features(
            p.tables["engagement"], p.reference_ts).select("member_id", "preferred_channel"),
        "features_temporal": lambda p: p.tables["members"].select("member_id").withColumns(
            features.temporal_features(p.reference_ts)),
        "member_features_raw": raw_features,
        "member_features": lambda p: p.features,
        "label_encode": label_encode,
        # profile
        "member_claim_summary": lambda p: profile.member_claim_summary(
            p.tables["members"], p.tables["claims"]).select("member_id", "claim_count", "total_claim_amount"),
        "describe_age": lambda p: profile.describe(p.tables["members"], "age"),
        "describe_claim_amount": lambda p: profile.describe(p.tables["claims"], "claim_amount"),
        "value_share": value_share,
        "claims_per_member": lambda p: profile.claims_per_member(p.tables["claims"]),
        "benefit_summary": lambda p: profile.benefit_summary(p.tables["benefits"]),
        "response_rate": lambda p: profile.response_rate(p.tables["engagement"]),
        "claim_amount_hist": lambda p: profile.claim_amount_histogram(p.tables["claims"]),
        "feature_histograms": lambda p: profile.feature_histograms(p.features),
        "corr_members_claims": lambda p: profile.correlation(profile.member_claim_summary(
            p.tables["members"], p.tables["claims"]), fv.MEMBER_CORRELATION_COLUMNS),
        "corr_features": lambda p: profile.correlation(p.features, fv.FEATURE_CORRELATION_COLUMNS),
        "feature_stats": lambda p: profile.feature_stats(p.features, fx),
        "feature_group_stats": lambda p: profile.feature_group_stats(
            profile.feature_stats(raw_features(p).drop("member_id", *features.LABEL_COLUMNS, "preferred_channel"),
                                  [c for c in fx if not c.endswith("_encoded")])),
        "member_segments": lambda p: member_segments(p.features).select("member_id", "segment"),
        "segment_summary": lambda p: segment_summary(member_segments(p.features)),
        # scores
        "rule_scores": lambda p: scoring.rule_scores(p.features, p.catalog),
        "rule_scores_wide": lambda p: scoring.rule_scores_wide(p.features, p.catalog),
        "rule_boosts": lambda p: scoring.rule_boosts(p.features, p.catalog),
        "training_data": _training,
        "train_test_split": train_test,
        "standard_scale": lambda p: scoring.StandardScaler.fit(p.features, fx).transform(p.features),
        **{f"normalize_{m}": (lambda m: lambda p: scoring.normalize_scores(
            scoring.rule_scores(p.features, p.catalog), "score", m).select("member_id", "offer_id", "normalized"))(m)
           for m in ("minmax", "zscore", "percentile")},
        # ranking
        "top_offers_per_member": lambda p: ranking.top_offers_long(scoring.rule_scores(p.features, p.catalog), 5),
        "recommendations": lambda p: p.recommendations(),
        "recs_filtered": lambda p: p.recommendations(5, 60.0, ["fitness", "cost_savings"]),
        "recs_enriched": recs_enriched,
        "recs_category_cap": lambda p: ranking.cap_in_rows(p.member_recommendations(), 1).select("member_id", F.inline("recs")),
        "recs_cooldown": lambda p: ranking.apply_business_rules(
            p.recommendations(), {"cooldown_days": 30}, engagement=p.tables["engagement"], ref=p.reference_ts),
        "recs_high_value_boost": lambda p: ranking.apply_business_rules(
            p.recommendations(), {"high_value_boost": 5.0}, segments=member_segments(p.features)),
        "recs_for_sample": lambda p: p.recommendations().join(
            reports.sample_members(p.features.select("member_id"), 100), "member_id", "left_semi"),
        "campaign_top3": lambda p: ranking.campaign_in_rows(p.member_recommendations()),
        "campaign_export": lambda p: reports.campaign_export(p.recommendations(), p.reference_ts),
        # reports
        "offer_distribution": lambda p: reports.offer_distribution(p.recommendations()),
        "category_scores": lambda p: reports.category_scores(p.recommendations()),
        "category_share": lambda p: reports.category_share(p.recommendations()),
        "category_counts": lambda p: reports.category_counts(p.recommendations()),
        "top_offers": lambda p: reports.top_offer_counts(p.recommendations()),
        "recs_summary": lambda p: reports.summary_of_tally(p.tally),
        "recs_report": lambda p: reports.report_of_tally(p.tally),
        "recs_by_age_group": lambda p: reports.recs_by_age_group(p.recommendations(), p.tables["members"]),
        "score_hist_by_rank": lambda p: profile.histogram(
            p.recommendations(), F.col("priority_score"), 30, ["rank"]),
        "score_quartiles_by_category": lambda p: profile.score_quartiles(p.recommendations()),
        **{f"marketing_{m}": (lambda m: lambda p: reports.for_marketing(p.recommendations(), p.reference_ts, m))(m)
           for m in ("generic", "salesforce", "marketo")},
        "member_profile": profile_of_member,
        # quality
        "validate_members": validate_members_query,
        "validate_features": validate_features_query,
        "monitor_stats": lambda p: profile.monitor_stats(p.features, fx),
        "drift_check": drift_query,
        # explanations
        "rule_explanations": lambda p: factor_rows(p.explanations()),
        "top_factors": lambda p: factor_rows(p.explanations(1)),
        "factor_display": lambda p: explain.display_factors(
            p.explanations(), explain.rule_inputs(p.catalog, fx), explain.profile_columns()),
        "offer_prompt": member_prompts,
        "member_text": member_texts,
        "summary_prompt": summary_prompts,
        "member_export": member_export,
        "export_flat": lambda p: explain.flatten_export(explain.nested_in_rows(p.explained_members())),
        "consolidated": lambda p: p.consolidated(),
        "factors_json_roundtrip": factors_roundtrip,
        # feedback
        "feedback_stats": lambda p: feedback.feedback_stats(feedback.decided(p.tables["feedback"])),
        "feedback_by_offer": lambda p: feedback.feedback_by_offer(feedback.decided(p.tables["feedback"])),
        "feedback_totals": lambda p: feedback.feedback_totals(p.tables["feedback"]),
        "retrain_gate": lambda p: feedback.retrain_gate(feedback.decided(p.tables["feedback"])),
        "feedback_adjusted_scores": adjusted_scores,
        "members_with_feedback": lambda p: feedback.with_feedback(
            p.features.select("member_id"), feedback.decided(p.tables["feedback"])),
        "members_without_feedback": lambda p: feedback.without_feedback(
            p.features.select("member_id"), feedback.decided(p.tables["feedback"])),
        "feedback_oversampled": lambda p: feedback.oversample_feedback(
            p.features.select("member_id"), feedback.decided(p.tables["feedback"]), weight=0.9),
        # learning
        "regression_metrics": lambda p: learn.regression_metrics(p.offer_means()),
        "rmse_by_offer": lambda p: learn.rmse_by_offer(p.offer_means()),
        "latest_model_version": lambda p: feedback.latest_version(model_versions(p)),
        "champion_challenger": lambda p: feedback.compare_models(model_versions(p)),
        "gbt_train_metrics": gbt_train_metrics,
        "gbt_recommendations": gbt_recommendations,
        "gbt_checks": gbt_checks,
        "tree_additivity": tree_additivity,
        "feature_importance": lambda p: _model(p).feature_importance(p.spark),
        "feature_group_importance": lambda p: profile.feature_group_importance(_model(p).feature_importance(p.spark)),
        "tree_explanations": lambda p: factor_rows(p.tree_explanations(_model(p))),
        "challenger_metrics": challenger_metrics,
        "model_consolidated": lambda p: p.consolidated(_model(p), "1"),
        "model_export": lambda p: member_lines(explain.nested_export(p.explanations(model=_model(p)))),
        "model_factor_display": lambda p: explain.display_factors(
            p.explanations(model=_model(p)), fx, explain.profile_columns()),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    simple = {name: (lambda build: lambda spark, sf_dir: plain(build(pipeline(spark, sf_dir))))(build)
              for name, build in _simple().items()}
    return {**simple, "stream_feedback_counts": stream_feedback_counts,
            "stream_recommendations": stream_recommendations}
