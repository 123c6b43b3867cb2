"""Cleaning of raw measurements: clipping, sentinel masking, column dropping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import FleetSpec
from tidemark.functions.scalar import finite


def clip_values(raw: DataFrame, spec: FleetSpec, col: str = "value") -> DataFrame:
    """Clip ``col`` to the scale and flag what was cut; NaN becomes NULL.

    Clipping happens before any averaging, so a bucket mean never hides an overshoot.
    """
    lo, hi = spec.clip
    v = F.col("_v")
    return (
        raw.withColumn("_v", F.when(~F.isnan(F.col(col).cast("double")), F.col(col).cast("double")))
        .withColumn("is_high", F.coalesce(v > hi, F.lit(False)))
        .withColumn("is_low", F.coalesce(v < lo, F.lit(False)))
        .withColumn(col, F.when(v > hi, F.lit(float(hi))).when(v < lo, F.lit(float(lo))).otherwise(v))
        .drop("_v")
    )


def clip_counts(raw: DataFrame, spec: FleetSpec, col: str = "value") -> DataFrame:
    """Per series: rows, values above and values below the scale."""
    return clip_values(raw, spec, col).groupBy("env", "series_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("is_high").alias("n_high"),
        F.count_if("is_low").alias("n_low"),
    )


def mask_sentinels(df: DataFrame, sentinels: dict[str, list]) -> DataFrame:
    """Replace listed marker values by NULL; columns the table lacks are skipped."""
    return df.withColumns({
        c: F.when(~F.col(c).isin(list(bad)), F.col(c))
        for c, bad in sentinels.items() if c in df.columns
    })


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*[c for c in names if c in df.columns])


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; table has {df.columns}")
    return df


def null_non_finite(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in cols})
