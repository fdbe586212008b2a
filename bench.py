"""Time the headline queries; prints one JSON line.

``member_features`` builds and writes the feature table from the raw tables.
The queries after it read that table, as jobs that follow a feature job do.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from offerrank.plans import queries as registry  # noqa: E402

HEADLINE = [
    "features_claims", "features_benefits", "features_engagement", "describe_claim_amount", "value_share",
    "claim_amount_hist", "member_features", "feature_stats", "corr_members_claims", "member_segments",
    "segment_summary", "rule_scores", "top_offers_per_member", "recommendations", "recs_category_cap",
    "recs_summary", "recs_report", "normalize_percentile", "campaign_top3", "consolidated", "member_lookup", "search_members",
    "factor_display", "member_export", "member_text", "validate_features", "corr_features", "feature_histograms", "drift_check",
    "feedback_totals", "feedback_adjusted_scores", "train_test_split", "regression_metrics", "champion_challenger",
    "stream_feedback_counts", "stream_recommendations", "gbt_train_metrics", "gbt_recommendations", "tree_explanations",
    "challenger_metrics", "model_consolidated",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    chosen = sys.argv[1:] or HEADLINE

    def run(name: str, folder: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    seconds = {}
    lookups = []
    with contextlib.redirect_stdout(sys.stderr):
        queries["scan_members"](spark, sf_dir).count()  # start the session, not the code paths
        for name in chosen:
            seconds[name] = run(name, sf_dir)
        if "recommendations" in chosen:  # from the raw tables, nothing written before
            registry.reset()
            seconds["recommendations_from_raw_tables"] = run("recommendations", sf_dir)
        if "member_lookup" in chosen:
            queries["member_lookup"](spark, sf_dir).collect()
            for _ in range(5):
                start = time.perf_counter()
                queries["member_lookup"](spark, sf_dir).collect()
                lookups.append(time.perf_counter() - start)
            seconds["member_lookup_again"] = round(min(lookups), 3)
    members = registry.pipeline(spark, sf_dir).tables["members"].count()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf"), "members": members}))
    spark.stop()


if __name__ == "__main__":
    main()
