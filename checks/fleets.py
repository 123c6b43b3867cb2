"""The three environments of the registered queries, at each stage of processing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import grid as G
from tidemark.operators.baselines import baseline_predictions
from tidemark.operators.features import feature_matrix
from tidemark.operators.metrics import per_series_metrics, with_mase_scale
from tidemark.operators.splits import with_split
from tidemark.sources.tables import FLEETS, SPECS

ALL = ("A", "B", "C")
DECIMALS = 6


def rounded(df: DataFrame, digits: int = DECIMALS) -> DataFrame:
    """Doubles rounded for display: sums may differ in the last digits between runs."""
    return df.select(*[
        (F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`")
        for n, t in df.dtypes])


def each(fn, envs=ALL) -> DataFrame:
    return reduce(DataFrame.unionByName, [fn(e) for e in envs])


def regular(spark: SparkSession, sf: str, env: str, max_gap: int | None = None) -> DataFrame:
    spec = SPECS[env]
    return G.regularise(G.to_grid(FLEETS[env](spark, sf), spec), spec, max_gap)


def grid(spark: SparkSession, sf: str, env: str) -> DataFrame:
    return G.cells(regular(spark, sf, env))


def matrix(spark: SparkSession, sf: str, env: str, mode: str = "N0", horizons=None) -> DataFrame:
    return feature_matrix(grid(spark, sf, env), SPECS[env], horizons, mode)


def scaled_matrix(spark: SparkSession, sf: str, env: str, horizons=None) -> DataFrame:
    """N0 matrix with split labels and the MASE scale on every row."""
    spec = SPECS[env]
    scaled = with_mase_scale(grid(spark, sf, env), spec)
    return with_split(feature_matrix(scaled, spec, horizons, carry=("d",)), spec)


def baseline_metrics(spark: SparkSession, sf: str, env: str, split: str | None = "test",
                     horizons=None) -> DataFrame:
    """Per-series metrics of the three baselines; one split, or all with ``split=None``."""
    p = baseline_predictions(scaled_matrix(spark, sf, env, horizons), SPECS[env])
    if split:
        p = p.where(F.col("split") == split)
    return per_series_metrics(p, ["env", "h", "model", "split", "series_id"])
