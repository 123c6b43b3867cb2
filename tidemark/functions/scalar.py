"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

SERIES = ["env", "series_id"]


def series_window(order: str = "bucket"):
    """Window of one series in time order; rows outside the grid (NULL bucket) come first."""
    return Window.partitionBy(*SERIES).orderBy(F.col(order).asc_nulls_first())


def whole_series():
    """Window over all rows of one series, at most one window of buckets."""
    return Window.partitionBy(*SERIES)


def finite(c: Column) -> Column:
    """NULL for NaN and infinities, the value otherwise."""
    return F.when(F.abs(c) < float("inf"), c)


def safe_div(a: Column, b: Column) -> Column:
    """``a / b`` with NULL for a zero denominator."""
    return a / F.when(b != 0, b)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate, NULL for a constant side.

    The built-in one raises a division error there in ANSI mode.
    """
    return safe_div(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def bucket_of(time_s: Column, grid_s: int) -> Column:
    return F.floor(time_s / F.lit(grid_s)).cast("long")


def seconds_of(bucket: Column, grid_s: int) -> Column:
    return bucket * F.lit(grid_s)


def hour_of_day(bucket: Column, grid_s: int) -> Column:
    return F.pmod(F.floor(seconds_of(bucket, grid_s) / 3600), F.lit(24))


def day_of_week(bucket: Column, grid_s: int) -> Column:
    """0 is Sunday: 1970-01-01 was a Thursday, day 4."""
    return F.pmod(F.floor(seconds_of(bucket, grid_s) / 86400) + 4, F.lit(7))


def cyclic(x: Column, period: int) -> tuple[Column, Column]:
    angle = 2 * F.pi() * x / F.lit(period)
    return F.sin(angle), F.cos(angle)


def median_of(c: Column | str) -> Column:
    """Exact median; use only where the group size is bounded."""
    return F.percentile(c, F.lit(0.5))


def epoch_seconds(c: str) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, whatever the session zone is."""
    t = F.col(c)
    return (
        F.unix_date(t.cast("date")).cast("long") * 86400
        + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    )
