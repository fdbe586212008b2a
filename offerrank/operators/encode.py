"""Label encoding: code = place among the sorted distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerrank.operators.quantiles import numbered_ranges
from offerrank.session import materialize


LABELS_AS_MAP = 64  # of a column; of more, a join finds the codes


class LabelEncoder:
    """Sorted labels per column; null counts as the label "None".

    The codes are a table of (column, value, code), fitted and applied on the
    cluster, so a column may have any number of labels: they are numbered in
    ranges, never all in one task.
    """

    def __init__(self, codes: DataFrame):
        self.codes = codes

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> "LabelEncoder":
        texts = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in columns])
        distinct = texts.unpivot([], columns, "column", "value").distinct()
        codes = numbered_ranges(distinct, ["value"], by=["column"])
        return cls(materialize(codes.select("column", "value", F.col("_before").cast("int").alias("code")), "labels"))

    def merged_with(self, other: "LabelEncoder") -> "LabelEncoder":
        return LabelEncoder(self.codes.unionByName(other.codes))

    def encode(self, df: DataFrame, columns: list[str], keep_null: list[str] = ()) -> DataFrame:
        """``df`` with ``<column>_encoded``; a value not seen in fitting is an error.

        Nulls of ``keep_null`` columns stay null. Up to ``LABELS_AS_MAP`` codes are
        looked up in the row, so that wide rows pass through no join; small tables
        of more codes are broadcast by size, larger ones join by shuffle.
        """
        few, looked_up = self._few_codes(columns), {}
        for c in columns:
            text = F.col(c).cast("string") if c in keep_null else F.coalesce(F.col(c).cast("string"), F.lit("None"))
            unseen = F.raise_error(F.concat(F.lit(f"unseen label in {c}: "), text)).cast("int")
            if c in few:
                known = F.create_map(*[F.lit(x) for pair in few[c] for x in pair])
                looked_up[f"{c}_encoded"] = F.when(text.isNotNull(), F.coalesce(F.try_element_at(known, text), unseen))
                continue
            own = self.codes.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
            code = F.when(F.col("_text").isNotNull(), F.coalesce("_code", unseen))
            df = (df.withColumn("_text", text).join(own, F.col("_text") == F.col("_value"), "left")
                  .withColumn(f"{c}_encoded", code).drop("_text", "_value", "_code"))
        return df.withColumns(looked_up) if looked_up else df

    def _few_codes(self, columns: list[str]) -> dict[str, list[tuple[str, int]]]:
        """(value, code) of the columns that have 1 to ``LABELS_AS_MAP`` of them."""
        codes = self.codes.where(F.col("column").isin(columns))
        counted = codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= LABELS_AS_MAP).collect()
        few: dict[str, list[tuple[str, int]]] = {r["column"]: [] for r in counted}
        for r in codes.where(F.col("column").isin(list(few))).collect() if few else []:
            few[r["column"]].append((r["value"], r["code"]))
        return few
