"""Small tables for tests."""

from __future__ import annotations

from tidemark.config import FleetSpec

# One-second buckets make bucket = time, and a window of 100 keeps the bounds readable:
# train [0, 70), validation [70, 85), test [85, 100).
SMALL = FleetSpec(grid_s=1, n_buckets=100, max_lag=6, lags=(1, 2, 3, 6), roll_widths=(3, 6), horizons=(1, 3),
                  season=10, n_folds=5, min_valid_rows=20)

RAW = "env string, series_id string, time_s long, value double"


def raw_table(spark, series: dict[str, list], env: str = "E", start: int = 0):
    """``None`` entries produce no row; use NaN for a row without a value."""
    rows = [(env, sid, start + i, float(v)) for sid, vals in series.items()
            for i, v in enumerate(vals) if v is not None]
    return spark.createDataFrame(rows, RAW)


def grid_table(spark, series: dict[str, list], env: str = "E", start: int = 0):
    """A table that is already on the grid; ``None`` is a missing value."""
    rows = [(env, sid, start, start + i, i, None if v is None else float(v), None if v is None else float(v), False)
            for sid, vals in series.items() for i, v in enumerate(vals)]
    return spark.createDataFrame(
        rows, "env string, series_id string, b0 long, bucket long, off long, y_obs double, y double, is_interp boolean")


def by_key(df, key: str, value: str) -> dict:
    return {r[key]: r[value] for r in df.select(key, value).collect()}


def series(df, col: str, sid: str | None = None) -> list:
    d = df if sid is None else df.where(df["series_id"] == sid)
    return [r[col] for r in d.orderBy("series_id", "bucket").collect()]
