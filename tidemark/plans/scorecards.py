"""Declared expectations checked against aggregates; every threshold is a row of data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import median_of, safe_div

RULE_SCHEMA = "rule string, item string, lo double, hi double"


def rules(spark: SparkSession, rows: list[tuple[str, str, float | None, float | None]]) -> DataFrame:
    """``(rule, item, lo, hi)``: the value of ``item`` must lie in [lo, hi]; NULL is open."""
    return spark.createDataFrame(rows, RULE_SCHEMA)


def count_items(tests: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict counts as items named ``key=.../verdict``."""
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.col("verdict"))
    return tests.groupBy(name.alias("item")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def median_items(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Medians over a results table (one row per test, so groups are small)."""
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return df.groupBy(name.alias("item")).agg(median_of(value).alias("value"))


def evaluate(rule_table: DataFrame, items: DataFrame, missing: float | None = None) -> DataFrame:
    """One row per rule: holds when all of its items are inside their bounds.

    An item without a measurement counts as ``missing`` (0 for verdict counts) or
    leaves the rule undecided.
    """
    x = rule_table.join(items, "item", "left")
    v = F.col("value") if missing is None else F.coalesce("value", F.lit(missing))
    ok = (F.coalesce(v >= F.col("lo"), F.col("lo").isNull())
          & F.coalesce(v <= F.col("hi"), F.col("hi").isNull()))
    x = x.withColumn("_v", v).withColumn("_ok", F.when(v.isNotNull(), ok))
    return x.groupBy("rule").agg(
        F.when(F.count("_ok") == F.count(F.lit(1)), F.bool_and("_ok")).alias("holds"),
        F.min("_v").alias("lowest"), F.max("_v").alias("highest"), F.count("_v").alias("n_items"))


def differenced_vs_naive(diagonal: DataFrame, naive: DataFrame) -> DataFrame:
    """Median over models of the N2 per-series median MAE, over the naive median."""
    from tidemark.functions.ordered import quantiles

    n2 = quantiles(diagonal.where(F.col("mode") == "N2"), ["target", "h", "model"], "mae", {"m": 0.5})
    n2 = n2.groupBy("target", "h").agg(median_of("m").alias("mae_n2"))
    nv = quantiles(naive, ["env", "h"], "mae", {"mae_naive": 0.5}).drop("n").withColumnRenamed("env", "target")
    return n2.join(nv, ["target", "h"]).withColumn("ratio", safe_div(F.col("mae_n2"), F.col("mae_naive")))


def compare_runs(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same quantity of two runs side by side; a row present in one run only stays visible."""
    a = first.select(*keys, F.col(value).alias("first"))
    b = second.select(*keys, F.col(value).alias("second"))
    return a.join(b, keys, "full_outer").withColumn("change", F.col("second") - F.col("first"))
