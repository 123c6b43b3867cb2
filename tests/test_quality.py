"""Every gate passes on a sound product and catches the error planted in it."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import SMALL, by_key, grid_table, raw_table
from tidemark.config import FleetSpec
from tidemark.functions.scalar import series_window
from tidemark.operators import catalog as C
from tidemark.operators import features as X
from tidemark.operators import grid as G
from tidemark.operators import metrics as M
from tidemark.operators import normalize as N
from tidemark.operators import splits as V
from tidemark.operators.baselines import baseline_predictions
from tidemark.plans import quality as Q

# Widths 6 and 12, which the rolling gates name, on a short window.
SPEC = FleetSpec(grid_s=3600, n_buckets=200, max_lag=24, horizons=(1, 6), season=24, min_valid_rows=20)


def _walk(seed, n=200):
    rng = random.Random(seed)
    out = [50.0]
    for _ in range(n - 1):
        out.append(min(100.0, max(0.0, out[-1] + rng.gauss(0, 4))))
    return out


DATA = {"a": _walk(1), "b": _walk(2)}


@pytest.fixture(scope="module")
def grid(spark):
    return grid_table(spark, DATA).persist()


@pytest.fixture(scope="module")
def matrix(grid):
    return X.feature_matrix(grid, SPEC).persist()


def _bad(df):
    return {r["check"] for r in df.collect() if r.n_bad > 0}


def test_catalog_gate(spark):
    reg = G.regularise(G.to_grid(raw_table(spark, {"a": [50 + i % 7 for i in range(100)], "b": [1.0] * 100}), SMALL), SMALL)
    cat = C.catalog(C.profile(reg, SMALL), SMALL, "h", "t")
    assert _bad(Q.catalog_gate(cat, {"E": "^[ab]$"})) == set()
    assert _bad(Q.catalog_gate(cat, {"E": "^a$"})) == {"id_well_formed"}
    assert "known_reason" in _bad(Q.catalog_gate(cat.withColumn("reject_reason", F.lit("bored"))))
    assert "kept_iff_no_reason" in _bad(Q.catalog_gate(cat.withColumn("kept", F.lit(True))))
    assert Q.duplicate_ids(cat).count() == 0 and Q.duplicate_ids(cat.unionByName(cat)).count() == 2
    assert [r.env for r in Q.missing_environments(cat, ["E", "F"]).collect()] == ["F"]
    assert Q.provenance_gate(cat).first().status == "ok"
    two = cat.unionByName(cat.withColumn("built_on", F.lit("other")))
    assert Q.provenance_gate(two).first().status == "fail"
    later = cat.unionByName(cat.withColumn("built_at", F.lit("later")))
    assert Q.provenance_gate(later).first().status == "warn"
    s = by_key(Q.schema_gate(cat.drop("p50"), cat.columns, exact=True), "check", "n_bad")
    assert s == {"missing_columns": 1, "extra_columns": 0}
    assert Q.shared_keys(cat, cat.where("series_id = 'a'"), ["series_id"]).count() == 1
    diff = Q.set_difference(cat, cat.where("series_id = 'a'"), ["series_id"]).collect()
    assert [(r.series_id, r.side) for r in diff] == [("b", "only_first")]


def test_numbers_against_reference(spark):
    got = spark.createDataFrame([("E", "n", 100.0), ("E", "m", 5.0)], "env string, quantity string, value double")
    exp = spark.createDataFrame([("E", "n", 101.0, 0.02), ("E", "m", 6.0, 0.02), ("E", "x", 1.0, 0.0)],
                                "env string, quantity string, value double, tolerance double")
    assert by_key(Q.against_reference(got, exp, ["env", "quantity"]), "quantity", "status") == {
        "n": "ok", "m": "fail", "x": "warn"}


def test_row_gates(matrix, grid):
    assert _bad(Q.null_counts(matrix, X.feature_names(SPEC), ["env"])) == set()
    holed = matrix.withColumn("lag_6", F.when(F.col("bucket") > 50, F.col("lag_6")))
    assert _bad(Q.null_counts(holed, X.feature_names(SPEC), ["env"])) == {"lag_6"}
    assert Q.first_valid_rows(matrix, SPEC).where("status <> 'ok'").count() == 0
    frame = X.feature_frame(grid, SPEC).where("target is not null")
    assert Q.first_valid_rows(frame, SPEC).where("status = 'fail'").count() == 4


def test_windows_that_contain_the_present_are_caught(matrix, grid):
    """A rolling window ending at t instead of t - 1 keeps every value inside its own range."""
    assert _bad(Q.rolling_gate(matrix, ["env"])) == set()
    assert all(r.status == "ok" for r in Q.shift_gate(matrix, ["env", "h"]).collect())
    frame = series_window().rowsBetween(-5, 0)
    wrong = grid.withColumns({
        "lag_1": F.lag("y", 1).over(series_window()), "diff_1": F.col("y") - F.lag("y", 1).over(series_window()),
        "roll_min_6": F.min("y").over(frame), "roll_max_6": F.max("y").over(frame), "h": F.lit(1)}).where("off > 10")
    assert all(r.status == "fail" for r in Q.shift_gate(wrong, ["env", "h"]).collect())


def test_window_across_series_is_caught(matrix, grid):
    """Without the series in the partition the deepest lag comes from another series."""
    stats = N.train_stats(grid, SPEC)
    z = X.feature_matrix(grid, SPEC, mode="N1")
    assert _bad(Q.normalised_recheck(grid, z, stats, SPEC)) == set()
    crossed = z.withColumn("lag_24", F.lag("lag_24", 1, 0.0).over(series_window()))
    assert _bad(Q.normalised_recheck(grid, crossed, stats, SPEC)) == {"deepest_lag"}
    shifted = z.withColumn("target", F.col("target") + 0.01)
    assert _bad(Q.normalised_recheck(grid, shifted, stats, SPEC)) == {"target"}


def test_lookups_take_no_shuffle_of_matrix_rows(grid):
    """All lookups are made by series, in the partitioning that the matrix has; buckets that are left out are not bridged."""
    import re

    out = Q.normalised_recheck(grid, X.feature_matrix(grid, SPEC, mode="N1"), N.train_stats(grid, SPEC), SPEC)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"hashpartitioning\([^)]*(?:bucket|_fb)", plan)
    z = X.feature_matrix(grid, SPEC, mode="N1")
    gap = z.groupBy("env", "series_id").agg(F.min("bucket").alias("low")).select("env", "series_id", (F.col("low") + 2).alias("bucket"))
    left = grid.join(gap, ["env", "series_id", "bucket"], "left_anti")
    found = {r.check: r.n_bad for r in Q.normalised_recheck(left, z, N.train_stats(grid, SPEC), SPEC).where("h = 1").collect()}
    n = gap.count()
    assert found["lag_1"] == found["value_at_t"] == found["target"] == found["target_present_in_raw"] == n


def test_calendar_offset_is_caught(matrix, grid):
    assert _bad(Q.calendar_gate(matrix, SPEC, ["env"])) == set()
    angle = 2 * F.pi() * F.pmod(F.floor(F.col("bucket") / 24) + 3, F.lit(7)) / 7
    assert _bad(Q.calendar_gate(matrix.withColumn("dow_sin", F.sin(angle)), SPEC, ["env"])) == {"dow_sin"}
    n1 = X.feature_matrix(grid, SPEC, mode="N1")
    assert _bad(Q.calendar_across_modes(matrix, n1)) == set()
    assert _bad(Q.calendar_across_modes(matrix, n1.withColumn("hour_cos", F.col("hour_cos") + 1))) == {"hour_cos"}


def test_statistics_over_the_whole_series_are_caught(matrix, grid):
    table = N.normalisation_table(grid, SPEC)
    good = X.feature_matrix(grid, SPEC, mode="N1")
    assert Q.recovered_parameters(matrix, good, table).first().status == "ok"
    leaky = FleetSpec(**{**SPEC.__dict__, "train_pct": 85, "val_pct": 10})
    bad = X.feature_matrix(grid, leaky, mode="N1")
    assert Q.recovered_parameters(matrix, bad, table).first().n_bad == 2
    population = good.withColumn("lag_1", F.col("lag_1") * math.sqrt(140 / 139))
    assert Q.recovered_parameters(matrix, population, table).first().n_bad == 2


def test_difference_gates(grid):
    m = X.feature_matrix(grid, SPEC, mode="N2")
    assert _bad(Q.n2_target_gate(m, ["env", "h"])) == set()
    one_step = m.withColumn("target", F.lead("target", 1).over(series_window()))
    assert _bad(Q.n2_target_gate(one_step, ["env", "h"])) == {"target_is_h_step_change"}
    assert Q.n2_row_law(grid, m, SPEC).where("status <> 'ok'").count() == 0
    assert Q.n2_row_law(grid, m.where("off <> 100"), SPEC).where("status = 'fail'").count() == 2
    c = Q.mode_counts({k: X.feature_matrix(grid, SPEC, mode=k) for k in N.MODES}).collect()
    assert all(r.n1_equals_n0 and r.n2_lost == 2 for r in c)


def test_dropping_null_features_instead_of_the_row_law_is_caught(spark):
    vals = list(DATA["a"])
    vals[60] = None
    g = grid_table(spark, {"a": vals})
    law = X.feature_matrix(g, SPEC, (1,))
    loose = X.feature_frame(g, SPEC, (1,)).dropna(subset=[*X.feature_names(SPEC), "target"])
    assert loose.count() > law.count()
    prof = spark.createDataFrame([("E", True, law.count(), 0)], "env string, kept boolean, valid_rows_h1 long, valid_rows_h6 long")
    one = {r.h: r.agrees for r in X.reconcile_rows(loose, prof, SPEC).collect()}
    assert one[1] is False and {r.h: r.agrees for r in X.reconcile_rows(law, prof, SPEC).collect()}[1]


def test_metric_identities(matrix, grid):
    p = baseline_predictions(V.with_split(matrix, SPEC), SPEC).withColumn("d", F.lit(1.0))
    per = M.per_series_metrics(p, ["env", "h", "model", "series_id"])
    assert _bad(Q.metric_identities(per, ["env"])) == set()
    assert _bad(Q.metric_identities(per.withColumn("smape", F.lit(250.0)), ["env"])) == {"smape_in_0_200"}
    assert _bad(Q.metric_identities(per.withColumn("rmse", F.col("mae") / 2), ["env"])) == {"rmse_not_below_mae"}
    agg = M.aggregate_metrics(per, ["env", "h", "model"], M.series_totals(grid))
    assert _bad(Q.aggregate_identities(agg, ["env"])) == set()
    assert _bad(Q.aggregate_identities(agg.withColumn("p75", F.col("p25") - 1), ["env"])) == {"quartiles_ordered", "iqr_is_difference"}
    assert Q.constant_total(agg, "env").first().status == "ok"
    assert Q.constant_total(agg.withColumn("n_excluded", F.col("h").cast("long")), "env").first().status == "fail"


def test_purge_gate(matrix, grid):
    counts = V.split_counts(V.with_split(matrix, SPEC))
    totals = M.series_totals(grid)
    assert Q.purge_gate(counts, totals).where("status <> 'ok'").count() == 0
    none = counts.withColumn("n_rows", F.when(F.col("split") == "purged", 0).otherwise(F.col("n_rows")).cast("long"))
    assert Q.purge_gate(none, totals).where("status = 'fail'").count() == 2


def test_groups_and_slices(spark, grid):
    g = spark.createDataFrame([("S", "a", "a"), ("G", "g0", "b"), ("G", "g0", "c"), ("rest", "", "d")],
                              "env string, series_id string, member string")
    assert _bad(Q.group_gate(g, 2)) == set() and _bad(Q.group_gate(g, 3)) == {"group_sizes"}
    twice = g.unionByName(spark.createDataFrame([("S", "b", "b")], g.schema))
    assert _bad(Q.group_gate(twice, 2)) == {"members_disjoint"}
    part = grid.where("series_id = 'a'")
    assert _bad(Q.slice_gate(part, grid, ["series_id", "bucket"], ["y"])) == set()
    assert _bad(Q.slice_gate(part.withColumn("y", F.col("y") + 1), grid, ["series_id", "bucket"], ["y"])) == {"y"}


def test_completeness_and_reproduction(spark):
    have = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), ("x", 1.0)], "k string, mae double")
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert by_key(Q.completeness(have, want, ["k"]), "check", "n_bad") == {"missing": 1, "extra": 1, "repeated": 1}
    first = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, mae double")
    assert Q.reproduction(first, first, ["k"]).first().status == "ok"
    off = first.withColumn("mae", F.col("mae") * 1.001)
    assert Q.reproduction(off, first, ["k"]).first().max_rel_change == pytest.approx(0.001)
    assert Q.reproduction(first.where("k = 'a'"), first, ["k"]).first().n_only_first == 1


def test_claims(spark):
    claimed = spark.createDataFrame([("a", 1.23, 2), ("b", 0.5, 1), ("c", 1.0, 0)], "item string, claim double, digits int")
    values = spark.createDataFrame([("a", 1.2345), ("b", 0.61)], "item string, value double")
    assert by_key(Q.claims(claimed, values), "item", "status") == {"a": "ok", "b": "differs", "c": "missing"}


def test_fingerprint_of_features(matrix):
    f = {(r.h, r.feature): r for r in Q.feature_fingerprint(matrix, SPEC, ["h"]).collect()}
    assert len(f) == 2 * 20 and f[1, "lag_1"].mean == pytest.approx(matrix.where("h = 1").agg(F.avg("lag_1")).first()[0])


def test_interpolation_share(spark):
    d = grid_table(spark, {"a": [1.0] * 10}).withColumn("is_interp", F.col("bucket") == 0)
    assert Q.interpolation_share(d).first().status == "warn" and Q.interpolation_share(d, 50).first().status == "ok"
