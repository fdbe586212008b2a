"""Top offers per member and the business rules on recommendations.

Scores of one member sit in one row as an array of at most catalog size, so
ranking needs no shuffle. Ties go to the offer that comes first in the catalog.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerrank.catalog import Catalog
from offerrank.functions.scalar import round_even, within_days
from offerrank.operators.scoring import with_rule_scores  # noqa: F401


def best_first(scores: Column) -> Column:
    """Score structs by falling score, then catalog order."""
    return F.sort_array(scores, asc=False)


def enrich(recs: DataFrame, catalog: Catalog) -> DataFrame:
    """Attach offer name, category and description; unknown offers keep defaults."""
    offers = catalog.offers_frame(recs.sparkSession).select(
        "offer_id", "offer_name", "category", "description")
    joined = recs.join(F.broadcast(offers), "offer_id", "left")  # the driver holds the whole list already
    return joined.withColumns({
        "offer_name": F.coalesce("offer_name", F.lit("Unknown")),
        "category": F.coalesce("category", F.lit("Unknown")),
        "description": F.coalesce("description", F.lit("")),
    })


def _ranked_rows(df: DataFrame, chosen: Column, keep: list[str]) -> DataFrame:
    rows = df.select(*keep, F.posexplode(chosen).alias("_place", "_pick"))
    return rows.select(*keep, (F.col("_place") + 1).alias("rank"),
                       F.col("_pick.offer_id").alias("offer_id"),
                       round_even(F.col("_pick.score"), 2).alias("priority_score"))


def top_offers(scored: DataFrame, n: int, keep: list[str] = ("member_id",)) -> DataFrame:
    """First ``n`` offers of a frame with a ``scores`` array column."""
    return _ranked_rows(scored, F.slice(best_first(F.col("scores")), 1, n), list(keep))


def top_offers_long(scores: DataFrame, n: int) -> DataFrame:
    """The same over long scores (member_id, offer_id, ord, score)."""
    place = Window.partitionBy("member_id").orderBy(F.desc("score"), "ord")
    return (scores.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)
            .select("member_id", "rank", "offer_id", round_even(F.col("score"), 2).alias("priority_score")))


def _chosen(catalog: Catalog, top_n: int, min_score: float | None, exclude_categories: list[str] | None) -> Column:
    """The offers of one member's ``scores`` that are recommended, best first."""
    chosen = F.slice(best_first(F.col("scores")), 1, 2 * top_n)
    if min_score:
        chosen = F.filter(chosen, lambda s: round_even(s["score"], 2) >= min_score)
    if exclude_categories:
        banned = catalog.ids_in_categories(exclude_categories)
        chosen = F.filter(chosen, lambda s: ~s["offer_id"].isin(banned))
    return F.slice(chosen, 1, top_n)


def recommend(scored: DataFrame, catalog: Catalog, top_n: int = 5, min_score: float | None = 30.0,
              exclude_categories: list[str] | None = None, keep: list[str] = ("member_id",)) -> DataFrame:
    """Cut to 2n, filter by rounded score and category, rank again, keep n.

    ``scored`` has a ``scores`` array column. Exclusions look at the first 2n
    offers only, so a member can end with fewer than n.
    """
    rows = _ranked_rows(scored, _chosen(catalog, top_n, min_score, exclude_categories), list(keep))
    return enrich(rows, catalog).select(
        *keep, "rank", "offer_id", "offer_name", "category", "priority_score", "description")


def recommend_in_rows(scored: DataFrame, catalog: Catalog, top_n: int = 5, min_score: float | None = 30.0,
                      factors: Callable[[Column], Column] | None = None) -> DataFrame:
    """The same offers as an array ``recs`` in each member's row; members without any are left out.

    ``factors`` gives the explanation of an offer id. What is made of a member's
    offers together then needs no shuffle.
    """
    # one literal for each map, however long the catalog
    known = [F.from_json(F.lit(json.dumps({o.offer_id: getattr(o, name) for o in catalog.offers})), "map<string, string>")
             for name in ("offer_name", "category", "description")]
    extra = (lambda s: [factors(s["offer_id"]).alias("top_features")]) if factors else (lambda s: [])
    recs = F.transform(_chosen(catalog, top_n, min_score, None), lambda s, i: F.struct(
        (i + 1).alias("rank"), s["offer_id"].alias("offer_id"), known[0][s["offer_id"]].alias("offer_name"),
        known[1][s["offer_id"]].alias("category"), round_even(s["score"], 2).alias("priority_score"),
        known[2][s["offer_id"]].alias("description"), *extra(s)))
    return scored.withColumn("recs", recs).where(F.size("recs") > 0).drop("scores")


def cap_per_category(recs: DataFrame, limit: int) -> DataFrame:
    """Keep the best ``limit`` offers of each category; ranks stay as they are."""
    place = F.row_number().over(Window.partitionBy("member_id", "category").orderBy("rank"))
    return recs.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def cap_in_rows(members: DataFrame, limit: int) -> DataFrame:
    """:func:`cap_per_category` on the arrays of :func:`recommend_in_rows`."""
    recs = F.col("recs")
    kept = F.filter(recs, lambda r, i: F.size(F.filter(F.slice(recs, F.lit(1), i), lambda q: q["category"] == r["category"])) < limit)
    return members.withColumn("recs", kept)


def cooldown(recs: DataFrame, engagement: DataFrame, ref: datetime, days: int) -> DataFrame:
    """Leave out members who saw or clicked an offer in the last ``days`` days."""
    recent = engagement.where(F.col("engagement_type").startswith("offer_")
                              & within_days(ref, F.col("engagement_date"), days))
    return recs.join(recent.select("member_id").distinct(), "member_id", "left_anti")


def high_value_boost(recs: DataFrame, segments: DataFrame, boost: float,
                     high_value: list[str] = ("High Utilizers", "High-Risk Chronic")) -> DataFrame:
    """Add ``boost`` to the scores of members in a high-value segment, up to 100."""
    valued = segments.select("member_id", F.col("segment").isin(list(high_value)).alias("_valued"))
    return recs.join(valued, "member_id", "left").withColumn(
        "priority_score",
        F.when(F.col("_valued"), F.least(F.lit(100.0), F.col("priority_score") + boost))
         .otherwise(F.col("priority_score"))).drop("_valued")


def apply_business_rules(recs: DataFrame, rules: dict, engagement: DataFrame | None = None,
                         segments: DataFrame | None = None, ref: datetime | None = None) -> DataFrame:
    """Apply the rules that are set: cooldown_days, high_value_boost, max_per_category."""
    result = recs
    if "cooldown_days" in rules:
        result = cooldown(result, engagement, ref, rules["cooldown_days"])
    if "high_value_boost" in rules:
        result = high_value_boost(result, segments, rules["high_value_boost"])
    if "max_per_category" in rules:
        result = cap_per_category(result, rules["max_per_category"])
    return result


def campaign_in_rows(members: DataFrame, n: int = 3) -> DataFrame:
    """:func:`campaign_offers` on the arrays of :func:`recommend_in_rows`."""
    names = F.transform(F.slice("recs", 1, n), lambda r: r["offer_name"])
    return members.select("member_id", F.array_join(names, ", ").alias(f"top_{n}_offers"))


def campaign_offers(recs: DataFrame, n: int = 3) -> DataFrame:
    """Names of the first ``n`` offers of each member as one text."""
    names = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("rank", "offer_name"))), 1, n),
                        lambda r: r["offer_name"])
    return (recs.where(F.col("rank").isNotNull()).groupBy("member_id")
            .agg(F.array_join(names, ", ").alias(f"top_{n}_offers")))
