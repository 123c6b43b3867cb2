"""Gap structure of regular series and the comparison of gap policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import FleetSpec
from tidemark.functions.ordered import keep, quantiles
from tidemark.functions.scalar import SERIES, median_of, series_window
from tidemark.operators.acf import short_acf


def _runs(df: DataFrame, inside: Column) -> DataFrame:
    """Maximal runs of consecutive buckets where ``inside`` holds: start, stop, length."""
    w = series_window()
    return (
        df.where(inside)
        .withColumn("_island", F.col("bucket") - F.row_number().over(w))
        .groupBy(*SERIES, "_island")
        .agg(F.min("bucket").alias("start"), (F.max("bucket") + 1).alias("stop"),
             F.count(F.lit(1)).alias("length"))
        .drop("_island")
    )


def gap_runs(df: DataFrame, col: str = "y_obs") -> DataFrame:
    return _runs(df, F.col(col).isNull())


def segments(df: DataFrame, min_len: int, col: str = "y_obs") -> DataFrame:
    """Runs of present values with at least ``min_len`` buckets."""
    return _runs(df, F.col(col).isNotNull()).where(F.col("length") >= min_len)


def gap_summary(df: DataFrame, spec: FleetSpec, col: str = "y_obs") -> DataFrame:
    """Per environment: gap count, median, p90 and longest length, share short enough to fill.

    A length is an integer no larger than the window, so the percentile buffer is bounded.
    """
    return gap_runs(df, col).groupBy("env").agg(
        F.count(F.lit(1)).alias("n_gaps"),
        F.sum("length").alias("n_missing"),
        median_of("length").alias("len_p50"),
        F.percentile("length", F.lit(0.9)).alias("len_p90"),
        F.max("length").alias("len_max"),
        F.avg((F.col("length") <= spec.max_gap).cast("double")).alias("short_share"),
    )


def forward_fill(df: DataFrame, limit: int, col: str = "y_obs", out: str = "y_ffill",
                 only_gaps_up_to: int | None = None) -> DataFrame:
    """Carry the last value forward over at most ``limit`` buckets.

    With ``only_gaps_up_to`` a gap is filled only if its whole length fits and a
    later value closes it or the series ends.
    """
    w = series_window()
    last = F.last(col, ignorenulls=True).over(w.rowsBetween(-limit, 0))
    if only_gaps_up_to is None:
        return df.withColumn(out, last)
    k = only_gaps_up_to
    # The run around a missing bucket fits when its ends are within k of each other.
    here = F.when(F.col(col).isNotNull(), F.col("bucket"))
    back = F.max(here).over(w.rowsBetween(-k, 0))
    ahead = F.min(here).over(w.rowsBetween(0, k))
    hi = F.max("bucket").over(Window.partitionBy(*SERIES)) + 1
    fits = F.coalesce(ahead, F.when(hi - F.col("bucket") <= k, hi)) - back - 1 <= k
    return (
        df.withColumn("_last", last).withColumn("_fits", F.coalesce(fits, F.lit(False)))
        .withColumn(out, F.when(F.col(col).isNotNull(), F.col(col))
                    .when(F.col("_fits"), F.col("_last")))
        .drop("_last", "_fits")
    )


def _row_law(col: str, spec: FleetSpec, h: int) -> Column:
    w = series_window()
    full = F.count(col).over(w.rowsBetween(-spec.max_lag, 0)) == spec.max_lag + 1
    return full & F.lead(col, h).over(w).isNotNull()


POLICIES = ("cut_after_ffill", "row_mask", "segments", "fill_then_segments", "fill_then_mask")


def gap_policies(df: DataFrame, spec: FleetSpec, min_segment: int = 288,
                 ffill_limit: int = 3, h_short: int = 1, h_long: int = 12) -> DataFrame:
    """Usable rows and units of five ways to treat gaps, per environment.

    ``df`` is a regular grid with the measured ``y_obs`` and the gap-filled ``y``.
    ``ratio_to_mask`` compares the long-horizon rows with the row mask.
    """
    lag = spec.max_lag
    w = series_window()
    flagged = keep(
        forward_fill(df, ffill_limit)
        .withColumn("_pos", F.row_number().over(w) - 1)
        .withColumn("_m1", _row_law("y_obs", spec, h_short))
        .withColumn("_m12", _row_law("y_obs", spec, h_long))
        .withColumn("_f1", _row_law("y", spec, h_short))
        .withColumn("_f12", _row_law("y", spec, h_long))
    )
    per = flagged.groupBy(*SERIES).agg(
        F.coalesce(F.min(F.when(F.col("y_ffill").isNull(), F.col("_pos"))),
                   F.count(F.lit(1))).alias("cut"),
        *[F.count_if(c).alias(c) for c in ("_m1", "_m12", "_f1", "_f12")],
    )
    cut_ok = F.col("cut") > lag + h_long

    def policy(name: str, rows1: Column, rows12: Column, unit: Column) -> Column:
        return F.struct(F.lit(name).alias("policy"), rows1.cast("long").alias("r1"),
                        rows12.cast("long").alias("r12"), unit.cast("long").alias("u"))

    by_series = per.select("env", F.explode(F.array(
        policy("cut_after_ffill", F.when(cut_ok, F.col("cut") - lag - h_short).otherwise(0),
               F.when(cut_ok, F.col("cut") - lag - h_long).otherwise(0), cut_ok),
        policy("row_mask", F.col("_m1"), F.col("_m12"), F.col("_m12") > 0),
        policy("fill_then_mask", F.col("_f1"), F.col("_f12"), F.col("_f12") > 0),
    )).alias("p")).select("env", "p.*")

    def cut_into(name: str, col: str) -> DataFrame:
        length = F.col("length")
        return segments(flagged, min_segment, col).select(
            "env", F.lit(name).alias("policy"),
            F.greatest(length - lag - h_short, F.lit(0)).alias("r1"),
            F.greatest(length - lag - h_long, F.lit(0)).alias("r12"),
            F.lit(1).cast("long").alias("u"))

    rows = by_series.unionByName(cut_into("segments", "y_obs")).unionByName(
        cut_into("fill_then_segments", "y"))
    total = rows.groupBy("env").pivot("policy", list(POLICIES)).agg(
        F.sum("r1").alias("r1"), F.sum("r12").alias("r12"), F.sum("u").alias("u"))
    base = F.greatest(F.coalesce(F.col("row_mask_r12"), F.lit(0)), F.lit(1))
    return total.select("env", F.explode(F.array(*[
        F.struct(
            F.lit(p).alias("policy"),
            F.coalesce(F.col(f"{p}_r1"), F.lit(0)).alias("rows_short"),
            F.coalesce(F.col(f"{p}_r12"), F.lit(0)).alias("rows_long"),
            F.coalesce(F.col(f"{p}_u"), F.lit(0)).alias("units"),
            (F.coalesce(F.col(f"{p}_r12"), F.lit(0)) / base).alias("ratio_to_mask"),
        ) for p in POLICIES])).alias("p")).select("env", "p.*")


def mask_bias(df: DataFrame, spec: FleetSpec, h: int = 1) -> DataFrame:
    """Median level of the rows the row mask keeps and of the measured rows it drops.

    Only series with at least one kept row take part.
    """
    flagged = df.withColumn("_keep", _row_law("y_obs", spec, h)).withColumn(
        "_any", F.max("_keep").over(Window.partitionBy(*SERIES)))
    rows = flagged.where(F.col("_any") & F.col("y_obs").isNotNull()).select(
        "env", F.when(F.col("_keep"), "kept").otherwise("dropped").alias("side"), "y_obs")
    return quantiles(rows, ["env", "side"], "y_obs", {"p50": 0.5})


def fill_safety(df: DataFrame, spec: FleetSpec, lags: tuple[int, int] = (1, 12),
                min_pairs: int = 30) -> DataFrame:
    """How much interpolation and forward fill move the autocorrelation of a series.

    Per environment and lag: medians of the three variants and the median and p95
    of the absolute change.  Series where any variant is undefined are left out.
    """
    k = spec.max_gap
    grid = forward_fill(df, k, only_gaps_up_to=k)
    wide = short_acf(grid, {"obs": "y_obs", "fill": "y", "ffill": "y_ffill"}, list(lags), min_pairs)
    cols = [f"{v}_{lag}" for v in ("obs", "fill", "ffill") for lag in lags]
    ok = wide.dropna(subset=cols)
    long = ok.select("env", "series_id", F.explode(F.array(*[
        F.struct(F.lit(lag).alias("lag"), F.lit(m).alias("measure"), c.alias("value"))
        for lag in lags
        for m, c in {
            "obs": F.col(f"obs_{lag}"), "fill": F.col(f"fill_{lag}"), "ffill": F.col(f"ffill_{lag}"),
            "fill_change": F.abs(F.col(f"fill_{lag}") - F.col(f"obs_{lag}")),
            "ffill_change": F.abs(F.col(f"ffill_{lag}") - F.col(f"obs_{lag}")),
        }.items()])).alias("m")).select("env", "series_id", "m.*")
    return quantiles(long, ["env", "lag", "measure"], "value", {"p50": 0.5, "p95": 0.95})
