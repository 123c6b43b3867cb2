"""Series screening: one catalog row per series, rejected series included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import FleetSpec
from tidemark.functions.scalar import SERIES, median_of, series_window
from tidemark.operators.grid import cells

REASONS = ("out_of_window", "near_dead", "constant", "too_few_rows")


def valid_row(spec: FleetSpec, h: int, col: str = "y"):
    """The row law: everything in ``[t - max_lag, t]`` present and ``t + h`` present.

    Stricter than "no NULL feature", because some of those buckets feed no feature.
    """
    w = series_window()
    full = F.count(col).over(w.rowsBetween(-spec.max_lag, 0)) == spec.max_lag + 1
    return full & F.lead(col, h).over(w).isNotNull()


def count_valid_rows(df: DataFrame, spec: FleetSpec) -> DataFrame:
    """Valid rows per series for every horizon, in one pass."""
    d = df.withColumns({f"_v{h}": valid_row(spec, h) for h in spec.horizons})
    return d.groupBy(*SERIES).agg(
        *[F.count_if(f"_v{h}").alias(f"valid_rows_h{h}") for h in spec.horizons])


def profile(regular: DataFrame, spec: FleetSpec) -> DataFrame:
    """Everything the catalog and the funnel need, in one aggregation per series.

    ``regular`` is the output of ``grid.regularise``, pass-through rows included, so
    a series that never enters the window still gets its row.  Rows per group are
    bounded by the window, hence the exact distinct count and median.
    """
    hs = sorted({*spec.horizons, spec.judge_h})
    d = regular.withColumns({f"_v{h}": valid_row(spec, h) for h in hs})
    p = d.groupBy(*SERIES).agg(
        F.count("y").alias("n_points"),
        F.count_if("is_interp").alias("n_interp"),
        *[F.count_if(f"_v{h}").alias(f"valid_rows_h{h}") for h in hs],
        F.avg("y_obs").alias("mean"),
        median_of("y_obs").alias("p50"),
        F.stddev_samp("y_obs").alias("_sd"),
        F.count("y_obs").alias("_n_obs"),
        F.max("in_window").alias("_seen"),
        F.sum("n_high").alias("n_clipped"),
        F.sum("n_rows").alias("n_raw_rows"),
        F.avg("y").alias("_mean_filled"),
        F.size(F.collect_set("y")).alias("_n_distinct"),
    )
    reason = (
        F.when(F.col("n_points") == 0, "out_of_window")
        .when(F.col("_mean_filled") < spec.min_mean, "near_dead")
        .when(F.col("_n_distinct") < spec.min_unique, "constant")
        .when(F.col(f"valid_rows_h{spec.judge_h}") < spec.min_valid_rows, "too_few_rows")
        .otherwise("")
    )
    return (
        p.withColumn("reject_reason", reason)
        .withColumn("kept", F.col("reject_reason") == "")
        .withColumn("std", F.when(F.col("_n_obs") > 1, F.col("_sd")).when(F.col("_seen"), F.lit(0.0)))
        .drop("_sd", "_n_obs", "_seen", "_mean_filled", "_n_distinct")
    )


def catalog(prof: DataFrame, spec: FleetSpec, built_on: str | None = None,
            built_at: str | None = None) -> DataFrame:
    """The published catalog columns, stamped with where and when they were built."""
    return prof.select(
        *SERIES, "kept", "reject_reason", "n_points", "n_interp",
        *[f"valid_rows_h{h}" for h in spec.horizons], "mean", "p50", "std", "n_clipped",
        F.lit(built_on).cast("string").alias("built_on"),
        F.lit(built_at).cast("string").alias("built_at"),
    )


def processed(regular: DataFrame, prof: DataFrame) -> DataFrame:
    """Grid rows of the kept series; both sides share the series partitioning."""
    return cells(regular).join(prof.where("kept").select(*SERIES), SERIES, "left_semi")


def funnel(prof: DataFrame, spec: FleetSpec) -> DataFrame:
    """Per environment: series in, out per reason, kept, valid rows, filled and clipped shares."""
    kept = F.col("kept")
    points = F.sum(F.when(kept, F.col("n_points")))
    return prof.groupBy("env").agg(
        F.count(F.lit(1)).alias("series_in"),
        *[F.count_if(F.col("reject_reason") == r).alias(f"out_{r}") for r in REASONS],
        F.count_if(kept).alias("series_kept"),
        *[F.coalesce(F.sum(F.when(kept, F.col(f"valid_rows_h{h}"))), F.lit(0)).alias(f"valid_rows_h{h}")
          for h in spec.horizons],
        (100 * F.sum(F.when(kept, F.col("n_interp"))) / F.when(points > 0, points)).alias("interp_pct"),
        (100 * F.sum("n_clipped") / F.sum("n_raw_rows")).alias("clipped_pct"),
        (F.sum(F.when(kept, F.col("mean") * F.col("n_points"))) / F.when(points > 0, points))
        .alias("target_mean"),
    )


def gap_sensitivity(regular: DataFrame, regular_unfilled: DataFrame, spec: FleetSpec) -> DataFrame:
    """Funnel with gap filling next to the funnel without it, in long form."""
    def stacked(name: str, reg: DataFrame) -> DataFrame:
        f = funnel(profile(reg, spec), spec)
        names = [c for c in f.columns if c != "env"]
        return f.select("env", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
            ["env"], names, "quantity", name)

    return stacked("filled", regular).join(stacked("unfilled", regular_unfilled), ["env", "quantity"])
