"""Exact global ranks and quantiles without a one-task sort.

Values fall into ordered buckets, and a pass over the data counts the buckets.
Only these counts, whose number is bounded by the bucket function, meet in one
window. Further passes look at the values of the few buckets that matter; a
bucket that still holds many rows is split again first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerrank.session import materialize

BUCKETS_PER_OCTAVE = 1024
_OFFSET = 1100 * BUCKETS_PER_OCTAVE  # log2 of the smallest double is -1074
PARTS_PER_SPLIT = 10_000
ROWS_PER_BUCKET = 1_000_000  # fewer are ranked within one task


def value_bucket(value: Column) -> Column:
    """A BIGINT that never decreases as ``value`` grows."""
    power = F.least(F.log2(F.abs(value)), F.lit(1025.0))  # infinity comes after all numbers
    octaves = F.floor(power * BUCKETS_PER_OCTAVE) + _OFFSET
    return F.when(value == 0, F.lit(0)).when(value > 0, octaves).otherwise(-octaves).cast("bigint")


def even_part(value: Column, low: Column, high: Column, parts: int) -> Column:
    """Which of the equal parts of [low, high] the value lies in, from 0."""
    bounded = F.greatest(low, F.least(high, value))
    share = (bounded - low) / F.when(high > low, high - low).otherwise(F.lit(1.0))
    return F.least(F.lit(parts - 1), F.floor(share * parts)).cast("bigint")


def _before(keys: list[str], order: list[str]) -> Column:
    """Rows in earlier buckets of the same key."""
    window = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order)
    return F.coalesce(F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _holding(buckets: DataFrame) -> DataFrame:
    """Buckets that hold one of the two ranks next to the quantile."""
    inside = lambda rank: (rank >= F.col("_start")) & (rank < F.col("_start") + F.col("_n"))
    return buckets.where(inside(F.col("_low")) | inside(F.col("_high")))


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None,
                    rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Linear-interpolation quantiles: rows of (by..., column, prob, value).

    Nulls and NaN are left out. A column without any value gives no row.
    """
    by = by or []
    keys = [*by, "_place"]  # of the column
    numbers = F.array(*[F.col(c).cast("double") for c in columns])
    values = (df.select(*by, F.posexplode(numbers).alias("_place", "_value"))
              .where(F.col("_value").isNotNull() & ~F.isnan("_value"))
              .withColumn("_bucket", value_bucket(F.col("_value"))))
    size = [F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_from"), F.max("_value").alias("_to")]
    span, asked = [*keys, "_bucket", "_start"], ["prob", "_low", "_high", "_share"]
    state = [*span, *asked, "_n", "_from", "_to"]

    position = F.col("prob") * (F.col("_total") - 1)
    buckets = values.groupBy(*keys, "_bucket").agg(*size)
    wanted = materialize(_holding(
        buckets.withColumn("_start", _before(keys, ["_bucket"]))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
        .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumns({"_low": F.floor(position), "_high": F.ceil(position),
                      "_share": position - F.floor(position)})).select(*state), "quantile-buckets")

    # a value meets its own bucket only, once, however many quantiles lie in it
    within = lambda: values.join(wanted.select(*span, "_from", "_to").distinct(), [*keys, "_bucket"]).where(
        F.col("_value").between(F.col("_from"), F.col("_to")))
    large = f"_n > {rows_per_bucket} AND _from < _to"
    while not wanted.where(large).isEmpty():
        part = even_part(F.col("_value"), F.col("_from"), F.col("_to"), PARTS_PER_SPLIT).alias("_part")
        split = within().groupBy(*span, part).agg(*size).withColumn("_inside", _before(span, ["_part"]))
        found = split.join(wanted.select(*span, *asked).distinct(), span).withColumn("_start", F.col("_start") + F.col("_inside"))
        wanted = materialize(_holding(found).select(*state), "quantile-buckets")

    counted = within().groupBy(*span, "_value").agg(F.count(F.lit(1)).alias("_n"))
    in_span = Window.partitionBy(*span).orderBy("_value")
    ranked = counted.withColumn("_end", F.col("_start") + F.sum("_n").over(in_span)).join(wanted.select(*span, *asked), span)
    holds = lambda rank: (rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_n"))
    picked = ranked.where(holds(F.col("_low")) | holds(F.col("_high"))).groupBy(*keys, "prob").agg(
        F.max(F.when(holds(F.col("_low")), F.col("_value"))).alias("_v_low"),
        F.max(F.when(holds(F.col("_high")), F.col("_value"))).alias("_v_high"),
        F.max("_share").alias("_share"))
    value = F.when(F.col("_share") == 0, F.col("_v_low")).otherwise(
        F.col("_v_low") * (1 - F.col("_share")) + F.col("_v_high") * F.col("_share"))
    name = F.element_at(F.array(*map(F.lit, columns)), F.col("_place") + 1)
    return picked.select(*by, name.alias("column"), "prob", value.alias("value"))


def quantile_row(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with a column ``name`` for each ``name: (column, prob)``."""
    columns = sorted({c for c, _ in wanted.values()})
    probs = sorted({p for _, p in wanted.values()})
    long = exact_quantiles(df, columns, probs)
    return long.agg(*[
        F.max(F.when((F.col("column") == c) & (F.col("prob") == float(p)), F.col("value"))).alias(name)
        for name, (c, p) in wanted.items()])


def numbered_ranges(df: DataFrame, order: list[str], count: str | None = None, by: list[str] = ()) -> DataFrame:
    """``df`` with ``_before``: how many rows (or the sum of ``count``) of the same ``by`` come earlier in ``order``.

    Rows are dealt out by ranges of (by..., order...) and numbered inside each
    range; only one sum for each range and ``by`` is added up, so no task holds
    more than its range.
    """
    amount = F.col(count) if count else F.lit(1)
    ranged = materialize(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *by)
    own = F.sum(amount).over(inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sums = ranged.groupBy("_range", *by).agg(F.sum(amount).alias("_sum")).collect()
    seen, starts = {}, []
    for r in sorted(sums, key=lambda r: r["_range"]):
        group = tuple(r[c] for c in by)
        starts.append((r["_range"], *group, seen.get(group, 0)))
        seen[group] = seen.get(group, 0) + r["_sum"]
    fields = ", ".join(["_range INT", *[f"`{c}` {dict(df.dtypes)[c]}" for c in by], "_start BIGINT"])
    placed = ranged.withColumn("_own", F.coalesce(own, F.lit(0)))
    return placed.join(df.sparkSession.createDataFrame(starts, fields), ["_range", *by]).withColumn(
        "_before", F.col("_start") + F.col("_own")).select(*df.columns, "_before")


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """Rows of (value, average rank from 1, total) for each distinct value."""
    known = df.where(F.col(column).isNotNull())
    counted = known.groupBy(F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = materialize(numbered_ranges(counted, ["_value"], "_n"), "ranks")
    total = ranked.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return ranked.select(F.col("_value").alias(column), (F.col("_before") + (F.col("_n") + 1) / 2).alias("average_rank"),
                         F.lit(total).alias("total"))


def first_by_hash(df: DataFrame, key: str, fraction: float, seed: str = "") -> DataFrame:
    """Mark the ``ceil(fraction * n)`` rows whose hashed key sorts first.

    Rows without a key come last, and since nothing tells them apart they are
    marked only when all rows are. Rows that repeat a key stay on one side.

    Small jobs find the hash at the cut; marking is then a comparison, so wide
    rows are not moved. Each job counts the next four hex digits of the hashes
    that begin like the cut: at most 65,536 counts, however many rows there are.
    """
    digest = F.md5(F.concat(F.lit(seed), F.col(key)))
    total, known = df.agg(F.count(F.lit(1)), F.count(key)).first()
    wanted = math.ceil(fraction * total)
    if wanted <= 0:
        return df.withColumn("is_first", F.lit(False))
    if wanted >= known:
        return df.withColumn("is_first", F.col(key).isNotNull() | F.lit(wanted >= total))
    hashed, prefix = df.select(digest.alias("_hash")), ""
    while len(prefix) < 32:
        counted = (hashed.where(F.col("_hash").startswith(prefix)).groupBy(F.substring("_hash", len(prefix) + 1, 4).alias("_next"))
                   .agg(F.count(F.lit(1)).alias("_n")))
        edge = (counted.withColumn("_before", _before([], ["_next"]))
                .where((F.col("_before") < wanted) & (F.col("_before") + F.col("_n") >= wanted)).first())
        prefix, wanted = prefix + edge["_next"], wanted - edge["_before"]
        if wanted == edge["_n"]:
            break  # all hashes that begin like this are wanted
    return df.withColumn("is_first", F.coalesce(F.substring(digest, 1, len(prefix)) <= F.lit(prefix), F.lit(False)))
