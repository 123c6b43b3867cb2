"""Lag, rolling, difference and calendar features with the strict row law.

All windows share one partitioning and one sort order, so a matrix for every
horizon at once costs one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import FleetSpec
from tidemark.functions.scalar import cyclic, day_of_week, hour_of_day, series_window
from tidemark.operators.clean import require_columns
from tidemark.operators.normalize import check_mode, transform

CALENDAR = ["hour_sin", "hour_cos", "dow_sin", "dow_cos"]
ROLL_STATS = ("mean", "std", "min", "max")


def feature_names(spec: FleetSpec, calendar: bool = True) -> list[str]:
    names = [f"lag_{k}" for k in spec.lags]
    names += [f"roll_{s}_{w}" for w in spec.roll_widths for s in ROLL_STATS]
    names.append("diff_1")
    return names + (CALENDAR if calendar else [])


def matrix_columns(spec: FleetSpec) -> list[str]:
    """The published matrix: two keys, the features, the target."""
    return ["series_id", "bucket", *feature_names(spec), "target"]


def lag_features(spec: FleetSpec, col: str) -> dict[str, Column]:
    w = series_window()
    return {f"lag_{k}": F.lag(col, k).over(w) for k in spec.lags}


def rolling_features(spec: FleetSpec, col: str) -> dict[str, Column]:
    """Over the ``w`` buckets before ``t``; missing unless all of them are present."""
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    out = {}
    for width in spec.roll_widths:
        frame = series_window().rowsBetween(-width, -1)
        full = F.count(col).over(frame) == width
        for stat in ROLL_STATS:
            out[f"roll_{stat}_{width}"] = F.when(full, fns[stat](col).over(frame))
    return out


def diff_feature(col: str) -> dict[str, Column]:
    return {"diff_1": F.col(col) - F.lag(col, 1).over(series_window())}


def calendar_features(spec: FleetSpec) -> dict[str, Column]:
    b = F.col("bucket")
    hour = cyclic(hour_of_day(b, spec.grid_s), 24)
    dow = cyclic(day_of_week(b, spec.grid_s), 7)
    return dict(zip(CALENDAR, (*hour, *dow)))


def feature_frame(df: DataFrame, spec: FleetSpec, horizons: tuple[int, ...] | None = None,
                  mode: str = "N0", carry: tuple[str, ...] = ()) -> DataFrame:
    """Features and targets of every row and horizon, before the row law.

    Besides keys, features and ``target`` (in the scale of ``mode``) a row carries
    what scoring needs: ``y`` at t, ``y_future`` at t + h, ``y_season``, ``mu``, ``sd``
    and ``valid``, the row law.  ``carry`` names further input columns to keep.
    """
    mode = check_mode(mode)
    require_columns(df, ["env", "series_id", "bucket", "off", "y"])
    horizons = tuple(horizons or spec.horizons)
    w = series_window()
    z = transform(df, spec, mode)
    if mode != "N1":
        z = z.withColumn("mu", F.lit(None).cast("double")).withColumn("sd", F.lit(None).cast("double"))
    full = F.count("z").over(w.rowsBetween(-spec.max_lag, 0)) == spec.max_lag + 1
    target = {
        h: F.lead("y", h).over(w) - F.col("y") if mode == "N2" else F.lead("z", h).over(w)
        for h in horizons
    }
    wide = z.select(
        "env", "series_id", "bucket", "off", "y", "mu", "sd", *carry,
        *[c.alias(n) for n, c in {**lag_features(spec, "z"), **rolling_features(spec, "z"),
                                  **diff_feature("z"), **calendar_features(spec)}.items()],
        F.lag("y", spec.season).over(w).alias("y_season"),
        full.alias("_full"),
        *[c.alias(f"_t{h}") for h, c in target.items()],
        *[F.lead("y", h).over(w).alias(f"_f{h}") for h in horizons],
    )
    per_h = F.explode(F.array(*[
        F.struct(F.lit(h).alias("h"), F.col(f"_t{h}").alias("target"), F.col(f"_f{h}").alias("y_future"))
        for h in horizons]))
    long = wide.withColumn("_h", per_h)
    return long.select(
        "env", "series_id", "bucket", "off", F.lit(mode).alias("mode"), "_h.h",
        *feature_names(spec), "_h.target", "y", "_h.y_future", "y_season", "mu", "sd", *carry,
        (F.col("_full") & F.col("_h.target").isNotNull()).alias("valid"))


def feature_matrix(df: DataFrame, spec: FleetSpec, horizons: tuple[int, ...] | None = None,
                   mode: str = "N0", carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows the row law admits."""
    return feature_frame(df, spec, horizons, mode, carry).where("valid").drop("valid")


def reconcile_rows(matrix: DataFrame, prof: DataFrame, spec: FleetSpec) -> DataFrame:
    """Matrix rows per (env, horizon) next to the sum the catalog announces."""
    got = matrix.groupBy("env", "h").agg(F.count(F.lit(1)).alias("n_matrix"))
    said = prof.where("kept").groupBy("env").agg(
        *[F.sum(f"valid_rows_h{h}").alias(f"_v{h}") for h in spec.horizons])
    said = said.select("env", F.explode(F.array(*[
        F.struct(F.lit(h).alias("h"), F.col(f"_v{h}").alias("n_catalog")) for h in spec.horizons
    ])).alias("v")).select("env", "v.*")
    return said.join(got, ["env", "h"], "full_outer").select(
        "env", "h", F.coalesce("n_catalog", F.lit(0)).alias("n_catalog"),
        F.coalesce("n_matrix", F.lit(0)).alias("n_matrix"),
        F.coalesce(F.col("n_catalog") == F.col("n_matrix"), F.lit(False)).alias("agrees"))
