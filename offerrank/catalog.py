"""The offer catalog as two small tables: offers and targeting rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerrank import fixed_values as fv

OFFER_SCHEMA = ("offer_id STRING, offer_name STRING, category STRING, base_score DOUBLE, "
                "description STRING, priority_weight DOUBLE, target_conditions ARRAY<STRING>, ord INT")
RULE_SCHEMA = "offer_id STRING, rule STRING, kind STRING, threshold DOUBLE, boost DOUBLE"


@dataclass(frozen=True)
class Offer:
    offer_id: str
    offer_name: str
    category: str
    base_score: float
    description: str = ""
    priority_weight: float = 1.0
    target_conditions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    offer_id: str
    name: str
    kind: str  # min, max or scale
    threshold: float | None
    boost: float

    def feature(self, available: list[str]) -> str | None:
        """The feature column the rule name stands for, None if there is none."""
        return Catalog.feature_of(self.name, available)

    def boost_sql(self, feature: str) -> str:
        """What the rule adds, as a SQL expression."""
        if self.kind == "scale":
            return f"coalesce(`{feature}`, 0) * {float(self.boost)}D"
        holds = f"`{feature}` {'>=' if self.kind == 'min' else '<='} {float(self.threshold)}D"
        return f"CASE WHEN {holds} THEN {float(self.boost)}D ELSE 0D END"

    def boost_column(self, feature: str) -> Column:
        return F.expr(self.boost_sql(feature))


class Catalog:
    """Offers in tie-break order with their rules; both may be replaced by tables."""

    def __init__(self, offers: list[Offer] | None = None, rules: list[Rule] | None = None):
        self.offers = offers if offers is not None else [
            Offer(i, n, c, b, d, w, tuple(t)) for i, n, c, b, d, w, t in fv.OFFERS]
        self.rules = rules if rules is not None else [Rule(*row) for row in fv.OFFER_RULES]

    @classmethod
    def from_frames(cls, offers: DataFrame, rules: DataFrame) -> "Catalog":
        """All offers in their order and all rules, by offer, kind of rule and threshold, as sums depend on the order."""
        rows = offers.orderBy("ord").collect()
        return cls([Offer(r.offer_id, r.offer_name, r.category, r.base_score, r.description,
                          r.priority_weight, tuple(r.target_conditions or ())) for r in rows],
                   [Rule(r.offer_id, r.rule, r.kind, r.threshold, r.boost)
                    for r in rules.orderBy("offer_id", "rule", "kind", "threshold", "boost").collect()])

    @staticmethod
    def feature_of(rule_name: str, available: list[str]) -> str | None:
        stem = rule_name.replace("_boost", "")
        return next((c for c in (stem, f"{stem}_encoded", f"has_{stem}") if c in available), None)

    @property
    def offer_ids(self) -> list[str]:
        return [o.offer_id for o in self.offers]

    def ids_in_categories(self, categories: list[str]) -> list[str]:
        return [o.offer_id for o in self.offers if o.category in categories]

    def offers_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(o.offer_id, o.offer_name, o.category, float(o.base_score), o.description,
                 float(o.priority_weight), list(o.target_conditions), place)
                for place, o in enumerate(self.offers)]
        return spark.createDataFrame(rows, OFFER_SCHEMA)

    def rules_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r.offer_id, r.name, r.kind, r.threshold, float(r.boost)) for r in self.rules]
        return spark.createDataFrame(rows, RULE_SCHEMA)

    def resolved_rules(self, available: list[str]) -> list[tuple[Rule, str]]:
        """(rule, feature) for the rules whose feature exists, in catalog order."""
        features = {name: self.feature_of(name, available) for name in {r.name for r in self.rules}}
        by_offer: dict[str, list[Rule]] = {}
        for r in self.rules:
            by_offer.setdefault(r.offer_id, []).append(r)
        pairs = ((r, features[r.name]) for o in self.offers for r in by_offer.get(o.offer_id, ()))
        return [(r, f) for r, f in pairs if f is not None]

    def unresolved_rules(self, available: list[str]) -> list[str]:
        """Names of rules that match no feature and therefore add nothing."""
        return [r.name for r in self.rules if r.feature(available) is None]
