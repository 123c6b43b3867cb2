"""Fact tables read as fleets of series: a group is a machine, a measure its utilisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import FleetSpec
from tidemark.functions.scalar import epoch_seconds


def as_series(df: DataFrame, env: str, series: Column, time_col: str, value: Column) -> DataFrame:
    return df.select(
        F.lit(env).alias("env"), series.alias("series_id"),
        epoch_seconds(time_col).alias("time_s"), value.cast("double").alias("value"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environment A: one series per event type."""
    return as_series(_table(spark, sf_dir, "events"), "A", F.col("event_type"), "ts", F.col("value"))


def order_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environment B: one series per order status and priority, square root of the price over 7."""
    return as_series(
        _table(spark, sf_dir, "orders"), "B", F.concat_ws("_", "o_orderstatus", "o_orderpriority"),
        "o_orderdate", F.sqrt("o_totalprice") / 7)


def supplier_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environment C: one series per supplier, quantity shipped."""
    return as_series(
        _table(spark, sf_dir, "lineitem"), "C", F.concat(F.lit("s"), "l_suppkey"),
        "l_shipdate", F.col("l_quantity"))


FLEETS = {"A": event_fleet, "B": order_fleet, "C": supplier_fleet}

# Hourly buckets over 30 days; weekly buckets over the years the orders span.
SPECS = {
    "A": FleetSpec(grid_s=3600, n_buckets=720, season=24, n_folds=4),
    "B": FleetSpec(grid_s=604800, n_buckets=340, season=52, n_folds=3, min_valid_rows=150),
    "C": FleetSpec(grid_s=604800, n_buckets=350, season=52, n_folds=4, min_valid_rows=250),
}
