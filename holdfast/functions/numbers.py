"""Time spans and number texts, written so that no session time zone or binary rounding leaks in."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F


def ntz(moment: datetime | str) -> Column:
    """Zone-free timestamp literal; it stays foldable, so filters on it reach the scan."""
    return F.lit(str(moment)).cast("timestamp_ntz")


def seconds(span: Column) -> Column:
    """Day-time interval as exact seconds."""
    return span.cast("interval second").cast("decimal(24,6)")


def whole_days(span: Column) -> Column:
    """Elapsed whole days of an interval, truncated (not calendar-day difference)."""
    return F.extract(F.lit("DAY"), span)


def ratio(numerator: Column, denominator: Column, otherwise=0.0) -> Column:
    """numerator / denominator, or `otherwise` when the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(otherwise))


def pct_text(value: Column) -> Column:
    """One-decimal percentage without the sign, e.g. 12.5."""
    return F.round(value, 1).cast("decimal(12,1)").cast("string")


def money_text(value: Column) -> Column:
    return F.round(value, 2).cast("decimal(18,2)").cast("string")


def count_text(value: Column) -> Column:
    return value.cast("bigint").cast("string")


def signed_text(value: Column) -> Column:
    """Two-decimal number with an explicit sign."""
    return F.concat(F.when(value < 0, "-").otherwise("+"), money_text(F.abs(value)))
