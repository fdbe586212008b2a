"""Scalar expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def timestamp_literal(ts: datetime) -> Column:
    """A constant in the session time zone, whatever zone Python runs in."""
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp")


def elapsed_days(ref: datetime, ts: Column) -> Column:
    """Whole 24-hour days from ``ts`` to ``ref``, floored; not calendar days."""
    micros = F.unix_micros(timestamp_literal(ref)) - F.unix_micros(ts)
    return F.floor(micros / F.lit(float(MICROS_PER_DAY))).cast("int")


def within_days(ref: datetime, ts: Column, days: int) -> Column:
    """``ts`` is not older than ``days`` days; future values count too."""
    return ts >= timestamp_literal(ref) - F.expr(f"INTERVAL {days} DAYS")


def bin_label(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the right-closed bin ``(low, high]``; "nan" outside all bins."""
    chain = F.when(value.isNull() | (value <= edges[0]), F.lit("nan"))
    for high, label in zip(edges[1:], labels):
        chain = chain.when(value <= high, F.lit(label))
    return chain.otherwise(F.lit("nan"))


def flag(condition: Column) -> Column:
    """1 when true, 0 when false or null."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def clip_score(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def safe_float(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def safe_int(value: Column, default: int = 0) -> Column:
    """Number truncated toward zero, ``default`` for bad, infinite or NaN input."""
    number = value.try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number).try_cast("bigint"), F.lit(default))


def safe_bool(text: Column) -> Column:
    """True for the strings true, 1 and yes in any case."""
    return F.coalesce(F.lower(text).isin("true", "1", "yes"), F.lit(False))


def round_even(value: Column, decimals: int) -> Column:
    """Scaled rounding with ties to even, the way numeric array code rounds.

    ``bround`` goes by the printed digits: it takes 0.575 for a tie although
    the stored number lies below it.
    """
    return F.rint(value * F.lit(float(10 ** decimals))) / F.lit(float(10 ** decimals))


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery.

    Attaching global statistics this way needs neither a collect on the driver
    nor a join; Spark runs the subquery once and treats it as a constant. Meant
    for a few values: every field that is used is planned as its own subquery.
    """
    return df.select(F.struct("*")).scalar()


def fitted(df: DataFrame) -> dict[str, float | None]:
    """The values of a one-row frame of statistics, brought to the driver.

    Meant for fitted constants that go into wide projections (medians, means).
    """
    return df.first().asDict()


def fixed_point(value: Column, decimals: int) -> Column:
    """Text with exactly ``decimals`` digits, ties to even (no grouping)."""
    return F.replace(F.format_number(value, decimals), F.lit(","), F.lit(""))


def short_decimal(value: Column) -> Column:
    """Text of a number that has at most two decimals: 45.0, 45.2, 45.25."""
    return F.regexp_replace(fixed_point(value, 2), "(\\.\\d)0$", "$1")


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter."""
    marked = F.regexp_replace(F.lower(text), "([^a-z ])([a-z])", "$1\u0001 $2")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))
