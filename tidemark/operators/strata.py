"""Burstiness of series and the strata built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import keep, quantiles
from tidemark.functions.scalar import SERIES, safe_div
from tidemark.functions.small import pin

STRATA = ("low", "mid", "high")


def burstiness(df: DataFrame, top: float = 100.0, col: str = "y") -> DataFrame:
    """Coefficient of variation per series and how close it is to the largest the scale allows.

    On a scale of [0, top] a series with mean m cannot have a CV above
    sqrt((top - m)/m), so raw CVs of differently loaded fleets are not comparable.
    """
    s = df.groupBy(*SERIES).agg(
        F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.count(col).alias("n_points"))
    s = s.withColumn("cv", safe_div(F.col("std"), F.col("mean"))).withColumn(
        "cv_bound", F.sqrt(safe_div(top - F.col("mean"), F.col("mean"))))
    return s.withColumn("bound_ratio", safe_div(F.col("cv"), F.col("cv_bound")))


def burstiness_summary(b: DataFrame) -> DataFrame:
    probs = {"cv_p5": 0.05, "cv_p25": 0.25, "cv_p50": 0.5, "cv_p75": 0.75, "cv_p95": 0.95}
    q = quantiles(b, ["env"], "cv", probs).withColumnRenamed("n", "n_series")
    r = quantiles(b, ["env"], "bound_ratio", {"bound_ratio_p50": 0.5}).drop("n")
    a = b.groupBy("env").agg(
        F.min("cv").alias("cv_min"), F.max("cv").alias("cv_max"), F.avg("cv").alias("cv_mean"),
        (100 * F.avg(F.coalesce((F.col("bound_ratio") >= 0.8).cast("double"), F.lit(0.0))))
        .alias("near_bound_pct"),
        F.count_if(F.col("bound_ratio") > 1.0001).alias("bound_violations"))
    iqr = F.col("cv_p75") - F.col("cv_p25")
    return (
        q.join(r, "env").join(a, "env")
        .withColumn("cv_iqr", iqr)
        .withColumn("cv_iqr_over_p50", safe_div(iqr, F.col("cv_p50")))
        .withColumn("mean_vs_p50_pct", 100 * (safe_div(F.col("cv_mean"), F.col("cv_p50")) - 1))
    )


def cv_thresholds(b: DataFrame) -> DataFrame:
    """Two cut points per environment; absolute cut points would not transfer between fleets."""
    return quantiles(b, ["env"], "cv", {"t1": 1 / 3, "t2": 2 / 3}).drop("n")


def assign_strata(b: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """``low`` below t1, ``mid`` from t1, ``high`` from t2."""
    b = keep(b)
    t = pin(cv_thresholds(b) if thresholds is None else thresholds)
    cv = F.col("cv")
    stratum = (
        F.when(cv < F.col("t1"), STRATA[0]).when(cv < F.col("t2"), STRATA[1])
        .when(cv.isNotNull(), STRATA[2])
    )
    return b.join(t, "env").withColumn("stratum", stratum).drop("t1", "t2")
