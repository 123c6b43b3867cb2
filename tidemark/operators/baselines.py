"""Forecasts that learn nothing: last value, moving average, last season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import FleetSpec
from tidemark.operators.clean import require_columns

BASELINES = ("naive", "ma6", "seasonal")


def baseline_columns(spec: FleetSpec) -> dict[str, Column]:
    """Expressions over an N0 feature matrix.

    The last value is rebuilt from two features, so a wrong matrix cannot hide
    behind a right baseline.  The moving average excludes ``t``.
    """
    return {
        "naive": F.col("lag_1") + F.col("diff_1"),
        "ma6": F.col(f"roll_mean_{spec.ma_width}"),
        "seasonal": F.col("y_season"),
    }


def baseline_predictions(matrix: DataFrame, spec: FleetSpec,
                         keep: tuple[str, ...] = ("env", "series_id", "bucket", "off", "h", "split"),
                         ) -> DataFrame:
    """Long form ``..., model, y_true, yhat``; a missing season stays NULL."""
    require_columns(matrix, ["lag_1", "diff_1", f"roll_mean_{spec.ma_width}", "y_season"])
    cols = baseline_columns(spec)
    carried = [c for c in (*keep, "d") if c in matrix.columns]
    return matrix.select(
        *carried, F.col("target").alias("y_true"),
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("model"), c.alias("yhat")) for n, c in cols.items()
        ])).alias("p")).select(*carried, "y_true", "p.*")


def seasonal_lookup(rows: DataFrame, grid: DataFrame, season: int, out: str = "y_season") -> DataFrame:
    """Value one season back by key, for rows that do not carry the full grid.

    A duplicate (series, bucket) in ``grid`` fails the job instead of multiplying rows.
    """
    key = ["env", "series_id", "bucket"]
    once = grid.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.first("y").alias("_y"))
    once = once.select(
        "env", "series_id", (F.col("bucket") + season).alias("bucket"),
        F.when(F.col("_n") == 1, F.col("_y")).otherwise(
            F.raise_error(F.concat(F.lit("duplicate grid row in series "), F.col("series_id")))
            .cast("double")).alias(out))
    return rows.join(once, key, "left")
