import math

import pytest
from pyspark.sql import functions as F

from helpers import SMALL, by_key, grid_table
from tidemark.operators import metrics as M

PRED = "env string, h int, model string, series_id string, y_true double, yhat double, d double"


def _per(spark, y, yhat, d=None):
    rows = [("E", 1, "m", "a", None if a is None else float(a), None if b is None else float(b), d)
            for a, b in zip(y, yhat)]
    return M.per_series_metrics(spark.createDataFrame(rows, PRED), ["env", "h", "model", "series_id"]).first()


def test_hand_computed_metrics(spark):
    assert _per(spark, [1, 2, 3], [2, 3, 4]).mae == 1
    assert _per(spark, [0, 0], [0, 2]).rmse == pytest.approx(math.sqrt(2))
    assert _per(spark, [1], [3]).smape == pytest.approx(100)
    assert _per(spark, [0, 0], [0, 0]).smape == 0
    assert _per(spark, [0, 5], [4, 0]).smape == pytest.approx(200)


def test_mase_scale_and_its_undefined_cases(spark):
    assert _per(spark, [1, 2, 3], [2, 3, 4], d=0.5).mase == 2
    assert _per(spark, [1, 2, 3], [2, 3, 4], d=0.0).mase is None
    assert _per(spark, [1, 2, 3], [2, 3, 4]).mase is None


def test_r2(spark):
    assert _per(spark, [1, 2, 3], [2, 2, 2]).r2 == pytest.approx(0)
    assert _per(spark, [1, 2, 3], [1, 2, 3]).r2 == pytest.approx(1)
    v = 1.1333333333333333
    assert _per(spark, [v] * 7, [1, 2, 1, 2, 1, 2, 1]).r2 is None


def test_non_finite_pairs_are_left_out_and_counted(spark):
    r = _per(spark, [1, 2, None, 4, float("nan")], [1, float("inf"), 3, 5, 1])
    assert r.n_rows == 2 and r.mae == 0.5


def test_mase_denominator_is_train_only_and_skips_gaps(spark):
    vals = [1.0, 2.0, None, 4.0, 6.0] + [6.0] * 65 + [50.0] * 30
    d = M.mase_scale(grid_table(spark, {"a": vals}), SMALL).first().d
    steps = [1.0, 2.0] + [0.0] * 65
    assert d == pytest.approx(sum(steps) / len(steps))
    carried = M.with_mase_scale(grid_table(spark, {"a": vals}), SMALL)
    assert carried.select("d").distinct().count() == 1 and carried.first().d == pytest.approx(d)


def _table(spark):
    rows = [("E", 1, "m", s, m, m, m, q, None) for s, m, q in (("a", 1.0, 1.0), ("b", 2.0, None), ("c", 4.0, 3.0))]
    return spark.createDataFrame(
        rows, "env string, h int, model string, series_id string, mae double, rmse double, smape double, mase double, r2 double")


def test_aggregation_counts_absent_series_as_excluded(spark):
    totals = spark.createDataFrame([("E", 5)], "env string, n_total long")
    a = {r.metric: r for r in M.aggregate_metrics(_table(spark), ["env", "h", "model"], totals).collect()}
    assert (a["mae"].p25, a["mae"].p50, a["mae"].p75, a["mae"].iqr) == (1.5, 2.0, 3.0, 1.5)
    assert (a["mae"].n_series, a["mae"].n_excluded) == (3, 2)
    assert (a["mase"].n_series, a["mase"].n_excluded) == (2, 3)
    assert a["r2"].p50 is None and a["r2"].n_excluded == 5


def test_rows_used(spark):
    per = spark.createDataFrame([("E", 1, "test", "s", "seasonal", 30), ("E", 1, "test", "t", "seasonal", 20)],
                                "env string, h int, split string, series_id string, model string, n_rows long")
    sizes = spark.createDataFrame([("E", 1, "test", 100)], "env string, h int, split string, n_rows long")
    r = M.rows_used(per, sizes, ["env", "h", "split"]).first()
    assert (r.n_used, r.n_split, r.dropped_pct) == (50, 100, 50.0)


def test_validation_score_is_the_median_over_series(spark):
    rows = [("E", 1, "m", s, 0.0, e, None) for s, e in (("a", 1.0), ("b", 2.0), ("c", 90.0))]
    s = M.validation_score(spark.createDataFrame(rows, PRED), ["env", "h"]).first()
    assert s.score == 2.0


def test_stratified_report(spark):
    strata = spark.createDataFrame([("E", "a", "low", 0.1, 0.2), ("E", "b", "low", 0.3, 0.4), ("E", "c", "high", 2.0, 0.9)],
                                   "env string, series_id string, stratum string, cv double, bound_ratio double")
    r = {(x.stratum, x.metric): x for x in M.stratified_report(_table(spark), strata, ["env", "h", "model"]).collect()}
    low = r["low", "mae"]
    assert (low.p50, low.n_series, low.n_excluded) == (1.5, 2, 0)
    assert low.cv_p50 == pytest.approx(0.2) and low.bound_ratio_p50 == pytest.approx(0.3)
    assert r["low", "mase"].n_excluded == 1 and r["high", "mae"].p50 == 4.0


def test_report_order(spark):
    df = spark.createDataFrame([("B", "ma6"), ("A", "other"), ("A", "ma6"), ("A", "naive")], "env string, model string")
    got = [tuple(r) for r in M.in_report_order(df, ["env", "model"], {"model": ["naive", "ma6", "seasonal"]}).collect()]
    assert got == [("A", "naive"), ("A", "ma6"), ("A", "other"), ("B", "ma6")]


def test_nested_medians(spark):
    df = spark.createDataFrame([("x", "a", 1.0), ("x", "a", 3.0), ("x", "b", 10.0), ("y", "a", 5.0)],
                               "g string, k string, v double")
    assert by_key(M.nested_medians(df, ["g", "k"], ["g"], "v", "m"), "g", "m") == {"x": 6.0, "y": 5.0}
