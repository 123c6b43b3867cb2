import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import SMALL, grid_table, raw_table, series
from tidemark.config import FleetSpec
from tidemark.functions.scalar import day_of_week, hour_of_day
from tidemark.operators import baselines as B
from tidemark.operators import features as X
from tidemark.operators import normalize as N
from tidemark.operators import splits as V

RNG = random.Random(7)
WALK = []
_v = 50.0
for _ in range(100):
    _v = min(100.0, max(0.0, _v + RNG.gauss(0, 3)))
    WALK.append(_v)


def _frame(spark, data, mode="N0", horizons=(1,)):
    return X.feature_frame(grid_table(spark, data), SMALL, horizons, mode)


def test_column_lists_have_the_published_order():
    names = X.feature_names(FleetSpec())
    assert len(names) == 19 and names[:6] == ["lag_1", "lag_2", "lag_3", "lag_6", "lag_12", "lag_24"]
    assert len(X.matrix_columns(FleetSpec())) == 22
    assert len(X.feature_names(FleetSpec(), calendar=False)) == 15


def test_lags_rolling_and_difference_by_hand(spark):
    d = _frame(spark, {"a": [1, 2, 4, 8, 16, 32, 64, 90]}).orderBy("bucket").collect()
    r = d[4]
    assert (r.lag_1, r.lag_3, r.diff_1) == (8, 2, 8)
    # Width 3 before t = 4: 2, 4, 8; the current value 16 is not part of it.
    assert (r.roll_min_3, r.roll_max_3) == (2, 8)
    assert r.roll_mean_3 == pytest.approx(14 / 3)
    assert r.roll_std_3 == pytest.approx(math.sqrt(((2 - 14 / 3) ** 2 + (4 - 14 / 3) ** 2 + (8 - 14 / 3) ** 2) / 2))
    assert r.target == 32 and d[7].target is None
    assert d[2].roll_mean_3 is None


def test_rolling_is_missing_when_one_point_is(spark):
    d = _frame(spark, {"a": [1, None, 3, 4, 5, 6]}).orderBy("bucket").collect()
    assert d[4].roll_mean_3 is None and d[5].roll_mean_3 == 4


def test_no_feature_sees_the_future(spark):
    changed = list(WALK)
    changed[60:] = [99 - v for v in changed[60:]]
    cols = [*X.feature_names(SMALL), "y"]
    a = _frame(spark, {"a": WALK}).where("bucket < 60").orderBy("bucket").select(*cols).collect()
    b = _frame(spark, {"a": changed}).where("bucket < 60").orderBy("bucket").select(*cols).collect()
    assert a == b


def test_series_do_not_leak_into_each_other(spark):
    alone = _frame(spark, {"b": WALK}).orderBy("bucket").collect()
    both = _frame(spark, {"a": WALK[::-1], "b": WALK}).where("series_id = 'b'").orderBy("bucket").collect()
    assert alone == both


def test_row_law_is_stricter_than_no_null_feature(spark):
    # The default lags skip t-23 .. t-13, so a hole there touches no feature.
    spec = FleetSpec(grid_s=1, n_buckets=200, horizons=(1,), n_folds=5)
    vals = [float(i % 9) for i in range(100)]
    vals[40] = None
    f = X.feature_frame(grid_table(spark, {"a": vals}), spec, (1,))
    row = f.where("bucket = 55").first()
    assert all(row[c] is not None for c in X.feature_names(spec)) and not row.valid
    assert X.feature_matrix(grid_table(spark, {"a": vals}), spec, (1,)).where("bucket = 65").count() == 1


def test_all_horizons_in_one_matrix(spark):
    m = X.feature_matrix(grid_table(spark, {"a": WALK}), SMALL)
    n = {r.h: r["count"] for r in m.groupBy("h").count().collect()}
    assert n == {1: 93, 3: 91}


def test_calendar(spark):
    d = spark.createDataFrame([(0,), (1,), (287,), (288,), (-1,)], "bucket long").select(
        "bucket", hour_of_day(F.col("bucket"), 300).alias("h"), day_of_week(F.col("bucket"), 300).alias("d"))
    got = {r.bucket: (r.h, r.d) for r in d.collect()}
    assert got == {0: (0, 4), 1: (0, 4), 287: (23, 4), 288: (0, 5), -1: (23, 3)}
    sunday = 3 * 288  # 1970-01-04
    assert spark.createDataFrame([(sunday,)], "bucket long").select(
        day_of_week(F.col("bucket"), 300).alias("d")).first().d == 0


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="off"):
        X.feature_frame(grid_table(spark, {"a": [1]}).drop("off"), SMALL)


# ------------------------------------------------------------------ normalisation


def test_train_statistics_ignore_later_values_and_gaps(spark):
    vals = [1.0, None, 3.0] + [2.0] * 67 + [99.0] * 30
    s = N.train_stats(grid_table(spark, {"a": vals}), SMALL).first()
    seen = [v for v in vals[:70] if v is not None]
    assert s.n_train == 69 and s.mu == pytest.approx(sum(seen) / 69) and s.usable


def test_flat_series_has_no_zscore(spark):
    d = grid_table(spark, {"a": [5.0] * 100})
    assert not N.train_stats(d, SMALL).first().usable
    assert set(series(N.transform(d, SMALL, "N1"), "z")) == {None}


def test_one_point_is_not_enough(spark):
    s = N.train_stats(grid_table(spark, {"a": [5.0] + [None] * 99}), SMALL).first()
    assert s.mu is None and s.sd is None and not s.usable


def test_difference_stays_inside_the_series(spark):
    d = N.transform(grid_table(spark, {"a": [1, 2, 4], "b": [10, 11, 13]}), SMALL, "N2")
    assert series(d, "z") == [None, 1, 2, None, 1, 2]


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="N3"):
        N.transform(grid_table(spark, {"a": [1]}), SMALL, "N3")


def test_difference_target_is_the_h_step_change(spark):
    m = X.feature_matrix(grid_table(spark, {"a": WALK}), SMALL, (3,), "N2")
    for r in m.collect():
        assert r.target == pytest.approx(WALK[r.bucket + 3] - WALK[r.bucket], abs=1e-12)
        assert r.diff_1 == pytest.approx(
            (WALK[r.bucket] - WALK[r.bucket - 1]) - (WALK[r.bucket - 1] - WALK[r.bucket - 2]), abs=1e-9)
    # One more bucket of history is needed than for the raw scale.
    assert m.count() == X.feature_matrix(grid_table(spark, {"a": WALK}), SMALL, (3,)).count() - 1


def test_round_trip_of_all_modes(spark):
    inv = {r.invariant: r for r in N.invariants(grid_table(spark, {"a": WALK, "b": WALK[::-1]}), SMALL).collect()}
    assert all(r.holds for r in inv.values())
    assert inv["naive_n0_n2"].max_error == 0.0


def test_samuelson_screen(spark):
    idle = [0.0] * 69 + [1.0] + [0.0] * 10 + [80.0] * 20
    d = grid_table(spark, {"idle": idle, "walk": WALK, "flat": [3.0] * 100})
    s = {r.series_id: r for r in N.samuelson_screen(d, SMALL).collect()}
    assert s["idle"].excluded and not s["walk"].excluded and not s["flat"].excluded
    assert all(r.n_violations == 0 for r in s.values())
    assert s["idle"].bound == pytest.approx(69 / math.sqrt(70))
    left = N.without_excluded(d, N.samuelson_screen(d, SMALL))
    assert {r.series_id for r in left.select("series_id").distinct().collect()} == {"walk", "flat"}


def test_normalisation_table_leaves_other_modes_empty(spark):
    t = N.normalisation_table(grid_table(spark, {"a": WALK}), SMALL).collect()
    assert {r.mode: r.mu is None for r in t} == {"N0": True, "N1": False, "N2": True}


# ------------------------------------------------------------------ splits


def _offsets(spark, h, n=2304):
    return spark.range(n).select(F.lit("E").alias("env"), F.col("id").alias("off"), F.lit(h).alias("h"))


@pytest.mark.parametrize("h", [1, 6, 12])
def test_split_sizes_and_purge(spark, h):
    d = V.split_counts(V.with_split(_offsets(spark, h), FleetSpec()))
    n = {r.split: r.n_rows for r in d.collect()}
    assert n == {"train": 1612 - h, "val": 345 - h, "test": 347 - h, "purged": 3 * h}


def test_fit_rows_stop_before_the_test_range(spark):
    d = V.fit_rows(_offsets(spark, 12), FleetSpec())
    assert d.agg(F.max(F.col("off") + F.col("h"))).first()[0] == 1956


def test_folds_expand_and_never_touch_test(spark):
    d = V.with_folds(_offsets(spark, 6), FleetSpec())
    got = {(r.fold, r.role): (r.lo, r.hi) for r in d.groupBy("fold", "role").agg(
        F.min("off").alias("lo"), F.max(F.col("off") + 6).alias("hi")).collect()}
    assert got[(0, "train")] == (0, 1611) and got[(0, "val")] == (1612, 1680)
    assert got[(4, "train")] == (0, 1887) and got[(4, "val")] == (1888, 1956)


# ------------------------------------------------------------------ baselines


def test_baselines_by_hand(spark):
    spec = SMALL
    m = V.with_split(X.feature_matrix(grid_table(spark, {"a": WALK}), spec, (1,)), spec)
    p = {r.model: r for r in B.baseline_predictions(m, spec).where("bucket = 40").collect()}
    assert p["naive"].yhat == pytest.approx(WALK[40])
    assert p["ma6"].yhat == pytest.approx(sum(WALK[34:40]) / 6)
    assert p["seasonal"].yhat == WALK[30]
    assert p["naive"].y_true == WALK[41]


def test_seasonal_stays_missing_before_the_first_season(spark):
    m = X.feature_matrix(grid_table(spark, {"a": WALK}), SMALL, (1,))
    early = B.baseline_predictions(m, SMALL).where("bucket = 8 and model = 'seasonal'").first()
    assert early.yhat is None


def test_seasonal_lookup_by_key_and_its_duplicate_check(spark):
    g = grid_table(spark, {"a": WALK})
    rows = g.where("bucket in (5, 20)").select("env", "series_id", "bucket")
    out = {r.bucket: r.y_season for r in B.seasonal_lookup(rows, g, 10).collect()}
    assert out == {5: None, 20: WALK[10]}
    with pytest.raises(Exception, match="duplicate grid row"):
        B.seasonal_lookup(rows, g.unionByName(g.where("bucket = 10")), 10).collect()
