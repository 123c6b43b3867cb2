import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helpers import SMALL, by_key, grid_table, raw_table, series
from tidemark.config import FleetSpec
from tidemark.operators import catalog as C
from tidemark.operators import gaps as P
from tidemark.operators import grid as G
from tidemark.operators.clean import clip_counts, clip_values, drop_columns, mask_sentinels, require_columns

SPEC = replace(SMALL, n_buckets=10)


def test_clip_counts_both_sides_and_keeps_missing(spark):
    raw = raw_table(spark, {"a": [-5, 0, 50, 100, 101, float("nan")]})
    vals = [r.value for r in clip_values(raw, SPEC).orderBy("time_s").collect()]
    assert vals == [0, 0, 50, 100, 100, None]
    row = clip_counts(raw, SPEC).first()
    assert (row.n_rows, row.n_high, row.n_low) == (6, 1, 1)


def test_sentinels_and_columns(spark):
    df = spark.createDataFrame([(-1.0, 1), (101.0, 2), (5.0, 3)], "io double, x int")
    out = mask_sentinels(df, {"io": [-1, 101], "absent": [0]})
    assert [r.io for r in out.orderBy("x").collect()] == [None, None, 5.0]
    assert drop_columns(out, ["x", "absent"]).columns == ["io"]
    with pytest.raises(ValueError, match="absent"):
        require_columns(df, ["io", "absent"])


def test_bucket_mean_and_floor(spark):
    rows = [("E", "a", t, v) for t, v in ((-1, 4.0), (0, 1.0), (299, 3.0), (300, 10.0))]
    raw = spark.createDataFrame(rows, "env string, series_id string, time_s long, value double")
    g = G.to_grid(raw, FleetSpec(n_buckets=10))
    assert {r.bucket: r.y for r in g.collect()} == {-1: 4.0, 0: 2.0, 1: 10.0}


def test_clip_before_mean(spark):
    raw = spark.createDataFrame([("E", "a", 0, 150.0), ("E", "a", 1, 50.0)],
                                "env string, series_id string, time_s long, value double")
    assert G.to_grid(raw, FleetSpec(n_buckets=4)).first().y == 75.0


def test_origin_counts_rows_without_value(spark):
    raw = raw_table(spark, {"a": [float("nan"), 1, 2], "b": [None, 5, 5]}, start=7)
    assert G.origins(raw, SPEC) == {"E": 7}


def test_many_environments_take_the_join_path(spark, monkeypatch):
    monkeypatch.setattr(G, "MAX_LITERAL_ENVS", 1)
    raw = raw_table(spark, {"a": [1, 2]}, env="E1").unionByName(raw_table(spark, {"a": [1, 2]}, env="E2", start=5))
    g = G.to_grid(raw, SPEC)
    assert {(r.env, r.b0) for r in g.collect()} == {("E1", 0), ("E2", 5)}


def _fill(spark, vals, k=2):
    spec = replace(SPEC, n_buckets=len(vals))
    reg = G.fleet_grid(raw_table(spark, {"a": vals, "full": [1] * len(vals)}), spec, k)
    d = reg.where("series_id = 'a'")
    return series(d, "y"), series(d, "is_interp")


def test_short_gap_is_filled_linearly(spark):
    y, flag = _fill(spark, [0, None, None, 9, 10])
    assert y == pytest.approx([0, 3, 6, 9, 10])
    assert flag == [False, True, True, False, False]


def test_long_gap_and_edges_stay_open(spark):
    y, flag = _fill(spark, [None, 1, None, None, None, 5, None])
    assert y == [None, 1, None, None, None, 5, None]
    assert not any(flag)


def test_k_zero_is_identity(spark):
    assert _fill(spark, [0, None, 2], k=0)[0] == [0, None, 2]


def test_anchor_outside_the_window_does_not_count(spark):
    spec = replace(SPEC, n_buckets=4)
    raw = raw_table(spark, {"a": [1, 2, 3, None, 5], "b": [1, 1, 1, 1, 1]})
    assert series(G.fleet_grid(raw, spec).where("series_id = 'a'"), "y") == [1, 2, 3, None]


def test_nan_becomes_missing_not_nan(spark):
    y, _ = _fill(spark, [1, float("nan"), 3])
    assert y == [1, 2, 3]


def test_every_series_gets_the_whole_window(spark):
    reg = G.fleet_grid(raw_table(spark, {"a": [1, 2], "b": [None, None, 4]}), SPEC)
    n = {r.series_id: r["count"] for r in reg.groupBy("series_id").count().collect()}
    assert n == {"a": 10, "b": 10}


def test_contiguous_grid_check(spark):
    holes = grid_table(spark, {"a": [1, 2, 3, 4]}).where("bucket <> 2")
    assert G.grid_breaks(holes).first().n_breaks == 1
    with pytest.raises(Exception, match="grid of series a has step 2"):
        G.assert_contiguous(holes).collect()
    ok = grid_table(spark, {"a": [1, 2], "b": [5, 6]})
    assert G.assert_contiguous(ok).count() == 4


def test_reindex_and_window(spark):
    df = grid_table(spark, {"a": [1, 2, 3]}).where("bucket <> 1").select("env", "series_id", "bucket", "y")
    bounds = spark.createDataFrame([("E", "a", 0, 3)], "env string, series_id string, lo long, hi long")
    assert series(G.reindex(df, bounds), "y") == [1, None, 3, None]
    assert series(G.apply_window(df, 0, 2), "y") == [1]


# ------------------------------------------------------------------ gaps


def test_gap_runs_and_segments(spark):
    d = grid_table(spark, {"a": [None, 1, None, None, 2, 3, 4, None], "b": [1] * 8})
    assert sorted((r.start, r.length) for r in P.gap_runs(d).collect()) == [(0, 1), (2, 2), (7, 1)]
    assert sorted((r.series_id, r.start, r.stop) for r in P.segments(d, 3).collect()) == [("a", 4, 7), ("b", 0, 8)]
    s = P.gap_summary(d, SPEC).first()
    assert (s.n_gaps, s.n_missing, s.len_max, s.short_share) == (3, 4, 2, 1.0)


def test_forward_fill_limit(spark):
    d = grid_table(spark, {"a": [None, 1, None, None, None, 5, None]})
    assert series(P.forward_fill(d, 2), "y_ffill") == [None, 1, 1, 1, None, 5, 5]
    short = P.forward_fill(d, 2, only_gaps_up_to=2)
    assert series(short, "y_ffill") == [None, 1, None, None, None, 5, 5]


def test_gap_policies_on_one_clean_and_one_broken_series(spark):
    spec = replace(SMALL, n_buckets=30, max_gap=2)
    vals = [float(i % 7) for i in range(30)]
    broken = list(vals)
    broken[15] = None
    raw = raw_table(spark, {"a": vals, "b": broken})
    got = {r.policy: (r.rows_short, r.rows_long, r.units)
           for r in P.gap_policies(G.fleet_grid(raw, spec), spec, min_segment=10, h_long=3).collect()}
    clean = (30 - 6 - 1, 30 - 6 - 3)
    assert got["fill_then_mask"] == (2 * clean[0], 2 * clean[1], 2)
    assert got["fill_then_segments"] == (2 * clean[0], 2 * clean[1], 2)
    # A gap of one is bridged by carrying forward, too.
    assert got["cut_after_ffill"] == (2 * clean[0], 2 * clean[1], 2)
    assert got["row_mask"] == (clean[0] + 15, clean[1] + 13, 2)
    # The two pieces have 15 and 14 buckets.
    assert got["segments"] == (clean[0] + (15 - 7) + (14 - 7), clean[1] + (15 - 9) + (14 - 9), 3)


def test_mask_bias_separates_kept_and_dropped(spark):
    # Dropped: six ones that lead in, one without a target, and the nines with too little history.
    vals = [1.0] * 20 + [None] + [9.0] * 8
    b = {r.side: (r.p50, r.n) for r in P.mask_bias(grid_table(spark, {"a": vals}), SMALL).collect()}
    assert b == {"kept": (1.0, 14), "dropped": (5.0, 14)}


# ------------------------------------------------------------------ catalog


def _wave(n):
    return [50 + i % 7 for i in range(n)]


def _profile(spark, data, spec=SMALL):
    reg = G.regularise(G.to_grid(raw_table(spark, data), spec), spec)
    return reg, C.profile(reg, spec)


def test_reject_reasons_in_order(spark):
    late = [None] * 150 + [5.0, 6.0]
    data = {"ok": _wave(100), "dead": [0.5, 0.2, 0.1] * 33, "flat": [7.0] * 100, "two": [7.0, 8.0] * 50,
            "tiny": _wave(12), "late": late}
    reg, prof = _profile(spark, data)
    assert by_key(prof, "series_id", "reject_reason") == {
        "ok": "", "dead": "near_dead", "flat": "constant", "two": "constant", "tiny": "too_few_rows",
        "late": "out_of_window"}
    row = prof.where("series_id = 'late'").first()
    assert (row.n_points, row.n_interp, row.valid_rows_h1, row["std"], row["mean"]) == (0, 0, 0, None, None)
    assert C.processed(reg, prof).select("series_id").distinct().collect()[0][0] == "ok"
    f = C.funnel(prof, SMALL).first()
    assert (f.series_in, f.series_kept, f.out_constant, f.out_out_of_window) == (6, 1, 2, 1)


def test_threshold_is_strict(spark):
    _, prof = _profile(spark, {"a": [0.5, 1.0, 1.5, 1.0] * 25})
    assert prof.first().reject_reason == ""


def test_catalog_statistics_use_measured_points_only(spark):
    vals = [10.0, None, 30.0] + _wave(97)
    _, prof = _profile(spark, {"a": vals})
    row = prof.first()
    seen = [v for v in vals if v is not None]
    assert row.n_points == 100 and row.n_interp == 1
    assert row["mean"] == pytest.approx(sum(seen) / len(seen))
    cat = C.catalog(prof, SMALL, "host", "now").first()
    assert cat.kept and cat.built_on == "host" and cat.n_clipped == 0


def test_clip_count_covers_rows_outside_the_window(spark):
    vals = _wave(100) + [None] * 10 + [500.0]
    assert _profile(spark, {"a": vals})[1].first().n_clipped == 1


def test_single_measured_bucket_has_zero_deviation(spark):
    row = _profile(spark, {"a": [5.0], "b": _wave(100)})[1].where("series_id = 'a'").first()
    assert row["std"] == 0.0 and row.reject_reason == "constant"


def test_one_missing_point_spoils_the_rows_around_it(spark):
    n, lag = 100, SMALL.max_lag
    vals = _wave(n)
    full = C.count_valid_rows(grid_table(spark, {"a": vals}), SMALL).first()
    assert full.valid_rows_h1 == n - lag - 1
    vals[50] = None
    holed = C.count_valid_rows(grid_table(spark, {"a": vals}), SMALL).first()
    # lag + 1 windows contain the point, one more row has it as its target.
    assert full.valid_rows_h1 - holed.valid_rows_h1 == lag + 2
    assert full.valid_rows_h3 - holed.valid_rows_h3 == lag + 2


def test_gap_sensitivity_shows_what_filling_gains(spark):
    raw = raw_table(spark, {"a": [None if i == 40 else v for i, v in enumerate(_wave(100))]})
    g = G.to_grid(raw, SMALL)
    s = {r.quantity: (r.filled, r.unfilled) for r in C.gap_sensitivity(
        G.regularise(g, SMALL), G.regularise(g, SMALL, 0), SMALL).collect()}
    assert s["valid_rows_h1"][0] - s["valid_rows_h1"][1] == SMALL.max_lag + 2
    assert s["interp_pct"] == (1.0, 0.0)


# ------------------------------------------------------------------ configuration


def test_default_bounds_and_folds():
    s = FleetSpec()
    assert s.bounds == {"train": (0, 1612), "val": (1612, 1957), "test": (1957, 2304)}
    assert [a for _, a, _ in s.fold_bounds] + [s.fold_bounds[-1][2]] == [1612, 1681, 1750, 1819, 1888, 1957]
    assert FleetSpec(n_buckets=720).bounds["train"] == (0, 504)
    assert math.isclose(sum(hi - lo for lo, hi in s.bounds.values()), 2304)


def test_bad_configuration_is_refused():
    for bad in ({"n_buckets": 0}, {"n_buckets": 10**9}, {"grid_s": 0}, {"horizons": (0,)}, {"max_gap": -1}):
        with pytest.raises(ValueError):
            FleetSpec(**bad)
    with pytest.raises(ValueError, match="folds"):
        FleetSpec(n_buckets=720).fold_bounds  # noqa: B018
