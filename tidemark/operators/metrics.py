"""Forecast errors per series and their distribution over the series of an environment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import FleetSpec
from tidemark.functions.ordered import keep, medians, quantiles
from tidemark.functions.scalar import SERIES, finite, median_of, safe_div, series_window, whole_series
from tidemark.functions.small import pin

METRICS = ("mae", "rmse", "smape", "mase", "r2")


def _step(spec: FleetSpec) -> Column:
    """Absolute one-bucket change where both ends lie in train and are present."""
    lo, hi = spec.bounds["train"]
    inside = (F.col("off") > lo) & (F.col("off") < hi)
    return F.when(inside, F.abs(F.col("y") - F.lag("y", 1).over(series_window())))


def mase_scale(df: DataFrame, spec: FleetSpec) -> DataFrame:
    """Denominator of MASE per series: train only, the same for every horizon."""
    return df.withColumn("_s", _step(spec)).groupBy(*SERIES).agg(F.avg("_s").alias("d"))


def with_mase_scale(df: DataFrame, spec: FleetSpec) -> DataFrame:
    """The same denominator carried on every row, within the series partitioning."""
    return df.withColumn("_s", _step(spec)).withColumn("d", F.avg("_s").over(whole_series())).drop("_s")


def per_series_metrics(pred: DataFrame, keys: list[str], y: str = "y_true",
                       yhat: str = "yhat") -> DataFrame:
    """All five metrics in one pass; ``keys`` include the series.

    Rows without a finite pair are left out and show in ``n_rows``.  A constant
    target is recognised by min = max, since a sum of squares rarely comes out
    as exactly zero.  MASE is NULL, never infinite, when its scale is 0 or missing.
    """
    rows = pred.where(finite(F.col(y)).isNotNull() & finite(F.col(yhat)).isNotNull())
    e = F.col(y) - F.col(yhat)
    half = (F.abs(F.col(y)) + F.abs(F.col(yhat))) / 2
    n = F.count(F.lit(1))
    scale = F.max("d") if "d" in pred.columns else F.lit(None).cast("double")
    total = F.var_pop(y) * n
    return rows.groupBy(*keys).agg(
        n.alias("n_rows"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (100 * F.avg(F.when(half == 0, F.lit(0.0)).otherwise(safe_div(F.abs(e), half)))).alias("smape"),
        safe_div(F.avg(F.abs(e)), scale).alias("mase"),
        F.when(F.min(y) != F.max(y), 1 - safe_div(F.sum(e * e), total)).alias("r2"),
    )


def series_totals(df: DataFrame) -> DataFrame:
    """Series per environment, the denominator of every ``n_excluded``."""
    return df.select(*SERIES).distinct().groupBy("env").agg(F.count(F.lit(1)).alias("n_total"))


def unpivot_metrics(per_series: DataFrame, keys: list[str],
                    metrics: tuple[str, ...] = METRICS) -> DataFrame:
    return per_series.select(*keys, *metrics).unpivot(keys, list(metrics), "metric", "value")


def aggregate_metrics(per_series: DataFrame, keys: list[str], totals: DataFrame | None = None,
                      total_on: str = "env", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Quartiles over series; ``n_series + n_excluded`` is the environment's series count.

    A series absent from the split counts as excluded, like one whose metric is
    undefined.
    """
    long = unpivot_metrics(per_series, keys, metrics)
    q = quantiles(long, [*keys, "metric"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    q = q.withColumnRenamed("n", "n_series").withColumn("iqr", F.col("p75") - F.col("p25"))
    if totals is None:
        n_all = per_series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"))
        q = q.join(n_all, keys)
    else:
        q = q.join(pin(totals.withColumnRenamed("env", total_on) if total_on != "env" else totals),
                   total_on)
    return q.select(*keys, "metric", "p25", "p50", "p75", "iqr", "n_series",
                    (F.col("n_total") - F.col("n_series")).alias("n_excluded"))


def rows_used(per_series: DataFrame, split_sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows a model could be scored on against rows of the split, with the share dropped."""
    used = per_series.groupBy(*keys, "model").agg(F.sum("n_rows").alias("n_used"))
    return used.join(pin(split_sizes.withColumnRenamed("n_rows", "n_split")), keys).withColumn(
        "dropped_pct", 100 * (1 - F.col("n_used") / F.col("n_split")))


def validation_score(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Model selection score: median over series of the MAE."""
    per = per_series_metrics(pred, list(dict.fromkeys([*keys, *SERIES])))
    return quantiles(per, keys, "mae", {"score": 0.5}).drop("n")


def stratified_report(per_series: DataFrame, strata: DataFrame, keys: list[str]) -> DataFrame:
    """Metric quartiles by stratum with the stratum's median CV and bound ratio."""
    d = keep(per_series.join(strata.select(*SERIES, "stratum", "cv", "bound_ratio"), SERIES, "left"))
    k = [*keys, "stratum"]
    levels = medians(d, k, ["cv", "bound_ratio"]).withColumnsRenamed({c: f"_r_{c}" for c in k})
    agg = _strata_quartiles(d, k)
    cond = F.lit(True)
    for c in k:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return agg.join(levels, cond).drop(*[f"_r_{c}" for c in k])


def _strata_quartiles(d: DataFrame, k: list[str]) -> DataFrame:
    long = d.select(*k, *METRICS).unpivot(k, list(METRICS), "metric", "value")
    sizes = long.groupBy(*k, "metric").agg(F.count(F.lit(1)).alias("_all")).select(
        *[F.col(c).alias(f"_s_{c}") for c in [*k, "metric"]], "_all")
    q = quantiles(long, [*k, "metric"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    cond = F.lit(True)
    for c in [*k, "metric"]:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return q.join(sizes, cond).select(
        *k, "metric", "p25", "p50", "p75", (F.col("p75") - F.col("p25")).alias("iqr"),
        F.col("n").alias("n_series"), (F.col("_all") - F.col("n")).alias("n_excluded"))


def in_report_order(df: DataFrame, by: list[str], ranked: dict[str, list[str]]) -> DataFrame:
    """Sort a result table by ``by``; columns in ``ranked`` follow the listed order of their values."""
    def key(c: str) -> Column:
        if c not in ranked:
            return F.col(c)
        place = F.array_position(F.array(*[F.lit(v) for v in ranked[c]]), F.col(c))
        return F.when(place > 0, place).asc_nulls_last()

    return df.orderBy(*[key(c) for c in by])


def nested_medians(df: DataFrame, inner: list[str], outer: list[str], value: str,
                   out: str) -> DataFrame:
    """Median over groups of the median inside each group; the outer groups are few."""
    m = quantiles(df, inner, value, {"_m": 0.5})
    return m.groupBy(*outer).agg(median_of("_m").alias(out), F.count("_m").alias("n_groups"))
