"""Whole analyses give the same rows when every table counts as too large for one task."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import grid_table
from tidemark.functions import ordered as O
from tidemark.operators import distribution as D
from tidemark.operators import metrics as M
from tidemark.operators import sampling as R
from tidemark.operators import strata as T
from tidemark.plans import rank_tests as H

RNG = random.Random(9)


def _both(monkeypatch, build, digits=9):
    """Rows of ``build()`` on the built-in path and on the value-range path."""
    def rows():
        out = []
        for r in build().collect():
            d = r.asDict()
            out.append(str(sorted((k, round(v, digits) if isinstance(v, float) else v) for k, v in d.items())))
        O.release()
        return sorted(out)

    small = rows()
    monkeypatch.setattr(O, "ROWS_PER_TASK", 15)
    large = rows()
    assert small == large and small
    return small


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(k, round(RNG.gauss(0.2, 1), 1), round(RNG.gauss(0, 1), 1)) for k in "xxxy" for _ in range(60)]
    return spark.createDataFrame(rows, "k string, a double, b double").repartition(5)


def test_wilcoxon(pairs, monkeypatch):
    _both(monkeypatch, lambda: H.wilcoxon(pairs, ["k"]))


def test_mann_whitney(pairs, monkeypatch):
    s = pairs.select("k", F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("a").alias("value")),
        F.struct(F.lit("b").alias("side"), F.col("b").alias("value")))).alias("s")).select("k", "s.*")
    _both(monkeypatch, lambda: H.mann_whitney(s, ["k"]))


def test_spearman(pairs, monkeypatch):
    _both(monkeypatch, lambda: H.spearman(pairs, ["k"], "a", "b"))


def test_metric_quartiles(spark, monkeypatch):
    rows = [("E", 1, m, f"s{i}", *[RNG.random() for _ in range(4)], None if i % 3 else RNG.random())
            for m in ("m", "n") for i in range(40)]
    per = spark.createDataFrame(rows, "env string, h int, model string, series_id string, mae double, rmse double,"
                                      " smape double, mase double, r2 double")
    _both(monkeypatch, lambda: M.aggregate_metrics(per, ["env", "h", "model"]))


def test_describe_and_strata(spark, monkeypatch):
    g = grid_table(spark, {f"s{i}": [RNG.choice([0.0, 100.0, 50 * RNG.random()]) for _ in range(30)] for i in range(20)})
    _both(monkeypatch, lambda: D.describe(g))
    monkeypatch.undo()
    _both(monkeypatch, lambda: T.assign_strata(T.burstiness(g)))
    monkeypatch.undo()
    _both(monkeypatch, lambda: T.burstiness_summary(T.burstiness(g)))


def test_samples_and_groups(spark, monkeypatch):
    df = spark.createDataFrame([(f"m{i}", float(i % 4)) for i in range(60)], "id string, v double")
    _both(monkeypatch, lambda: R.quantile_strata(df, "v", "id"))
    monkeypatch.undo()
    _both(monkeypatch, lambda: R.halves_and_groups(df, "id", 20, 5, "S", "G"))
