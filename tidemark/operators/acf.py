"""Autocorrelation of regular series.

Lags are window columns over the one (env, series) partitioning and are unfolded
after it, so a lag list of any length costs no extra shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import FleetSpec
from tidemark.functions.ordered import quantiles
from tidemark.functions.scalar import (
    SERIES, correlation, finite, safe_div, series_window, whole_series,
)

MIN_PAIRS = 30
MIN_SUM_OF_SQUARES = 1e-12


def _pearson(a: Column, b: Column, min_pairs: int) -> tuple[Column, Column]:
    """Pairwise-complete correlation and pair count; NULL when too few or nearly constant."""
    both = a.isNotNull() & b.isNotNull()
    pa, pb = F.when(both, a), F.when(both, b)
    n = F.count(pa)
    spread = (F.var_pop(pa) * n > MIN_SUM_OF_SQUARES) & (F.var_pop(pb) * n > MIN_SUM_OF_SQUARES)
    return F.when((n >= min_pairs) & spread, finite(correlation(pa, pb))), n


def acf(df: DataFrame, lags: list[int], col: str = "y", min_pairs: int = MIN_PAIRS) -> DataFrame:
    """Per series and lag: ``acf``, usable pairs and pairs the window could hold."""
    w = series_window()
    lagged = df.select(*SERIES, F.col(col).alias("_b"), (F.row_number().over(w) - 1).alias("_pos"),
                       F.array(*[F.struct(F.lit(k).alias("lag"), F.lag(col, k).over(w).alias("_a"))
                                 for k in lags]).alias("_lags"))
    pairs = lagged.select(*SERIES, "_b", "_pos", F.explode("_lags").alias("_l")).select(
        *SERIES, "_b", "_pos", "_l.lag", "_l._a")
    r, n = _pearson(F.col("_a"), F.col("_b"), min_pairs)
    return pairs.groupBy(*SERIES, "lag").agg(
        r.alias("acf"), n.alias("n_pairs"),
        F.count_if(F.col("_pos") >= F.col("lag")).alias("n_slots"))


def short_acf(df: DataFrame, cols: dict[str, str], lags: list[int],
              min_pairs: int = MIN_PAIRS) -> DataFrame:
    """Wide form for a few lags of several columns: one row per series, ``<name>_<lag>``."""
    w = series_window()
    shifted = df.select(*SERIES, *set(cols.values()), *[
        F.lag(c, k).over(w).alias(f"_{name}_{k}") for name, c in cols.items() for k in lags])
    return shifted.groupBy(*SERIES).agg(*[
        _pearson(F.col(f"_{name}_{k}"), F.col(c), min_pairs)[0].alias(f"{name}_{k}")
        for name, c in cols.items() for k in lags])


def classical_acf(df: DataFrame, spec: FleetSpec, lags: dict[str, int]) -> DataFrame:
    """ACF with one mean and the full variance as denominator, on the train range only."""
    lo, hi = spec.bounds["train"]
    train = df.where((F.col("off") >= lo) & (F.col("off") < hi))
    d = train.withColumn("_d", F.col("y") - F.avg("y").over(whole_series()))
    w = series_window()
    d = d.withColumns({f"_d_{name}": F.lag("_d", k).over(w) for name, k in lags.items()})
    total = F.sum(F.col("_d") * F.col("_d"))
    return d.groupBy(*SERIES).agg(*[
        (F.coalesce(F.sum(F.col("_d") * F.col(f"_d_{name}")), F.lit(0.0))
         / F.when(total > 0, total)).alias(name)
        for name in lags])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def partial_autocorrelations(acf_by_lag: pd.Series) -> pd.Series:
    """Durbin-Levinson over a batch of series at once.

    A series is given up (NULL) when its ACF is incomplete or the recursion loses
    stability, since pairwise estimates need not be positive definite.
    """
    rho = np.array([np.array(a, dtype="float64") for a in acf_by_lag])
    n, k_max = rho.shape
    phi = np.full((n, k_max), np.nan)
    alive = np.isfinite(rho).all(axis=1)
    if k_max:
        phi[alive, 0] = rho[alive, 0]
    coef = np.zeros((n, k_max))
    coef[:, 0] = np.where(alive, rho[:, 0], 0.0)
    left = 1.0 - coef[:, 0] ** 2
    for k in range(1, k_max):
        alive = alive & (left > 1e-10)
        used = coef[:, :k]
        explained = np.einsum("ij,ij->i", used, np.nan_to_num(rho[:, k - 1::-1] if k > 0 else rho))
        p = (np.nan_to_num(rho[:, k]) - explained) / np.where(alive, left, 1.0)
        alive = alive & np.isfinite(p) & (np.abs(p) < 1.0)
        p = np.where(alive, p, 0.0)
        coef[:, :k] = used - p[:, None] * used[:, ::-1]
        coef[:, k] = p
        phi[alive, k] = p[alive]
        left = left * (1.0 - p * p)
    return pd.Series([[None if np.isnan(v) else float(v) for v in row] for row in phi])


def pacf(acf_table: DataFrame, max_lag: int) -> DataFrame:
    """PACF for lags 1..max_lag from an :func:`acf` table that covers them all."""
    per = (
        acf_table.where(F.col("lag").between(1, max_lag)).groupBy(*SERIES)
        .agg(F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("_l"))
        .where(F.size("_l") == max_lag)
        .withColumn("pacf", partial_autocorrelations(F.transform("_l", lambda s: s["acf"])))
    )
    return per.select(*SERIES, F.posexplode("pacf").alias("_k", "pacf")).select(
        *SERIES, (F.col("_k") + 1).alias("lag"), "pacf")


def acf_summary(acf_table: DataFrame) -> DataFrame:
    """Per environment and lag: quartiles over series and share of pairs lost to gaps."""
    probs = {"acf_p25": 0.25, "acf_p50": 0.5, "acf_p75": 0.75}
    q = quantiles(acf_table, ["env", "lag"], "acf", probs).withColumnRenamed("n", "n_series")
    lost = acf_table.groupBy("env", "lag").agg(
        (100 * (1 - safe_div(F.sum("n_pairs"), F.sum("n_slots")))).alias("pairs_lost_pct"))
    return q.join(lost, ["env", "lag"])


def pacf_summary(pacf_table: DataFrame, max_lag: int) -> DataFrame:
    """Medians per lag over the series whose recursion reached ``max_lag``; the rest is counted."""
    done = F.max(F.when(F.col("lag") == max_lag, F.col("pacf"))).over(whole_series())
    d = pacf_table.withColumn("_done", done.isNotNull())
    counts = d.where(F.col("lag") == max_lag).groupBy("env").agg(
        F.count_if("_done").alias("n_series"), F.count_if(~F.col("_done")).alias("n_dropped"))
    q = quantiles(d.where("_done"), ["env", "lag"], "pacf", {"pacf_p50": 0.5}).drop("n")
    return q.join(counts, "env")
