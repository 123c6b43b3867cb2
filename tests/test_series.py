import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SMALL, by_key, grid_table
from tidemark.operators import acf as A
from tidemark.operators import distribution as D
from tidemark.operators import gaps as P
from tidemark.operators import strata as T
from tidemark.plans import clusters as K

SF = "/root/testdata/sf0.001"
RNG = random.Random(11)
AR = [50.0]
for _ in range(99):
    AR.append(50 + 0.8 * (AR[-1] - 50) + RNG.gauss(0, 2))
HOLED = [None if i in (10, 11, 40, 41, 42) else v for i, v in enumerate(AR)]


def _pairs(vals, k):
    return [(a, b) for a, b in zip(vals[:-k], vals[k:]) if a is not None and b is not None]


def test_pairwise_acf_equals_numpy(spark):
    got = {r.lag: r for r in A.acf(grid_table(spark, {"a": HOLED}), [1, 5, 12]).collect()}
    for k in (1, 5, 12):
        p = _pairs(HOLED, k)
        assert got[k].acf == pytest.approx(np.corrcoef(*zip(*p))[0, 1])
        assert (got[k].n_pairs, got[k].n_slots) == (len(p), 100 - k)


def test_acf_is_undefined_for_few_pairs_or_a_flat_series(spark):
    few = grid_table(spark, {"a": AR[:20]})
    assert A.acf(few, [1]).first().acf is None
    assert A.acf(grid_table(spark, {"a": [3.0] * 100}), [1]).first().acf is None


def _levinson(rho):
    """Textbook recursion on one series, as the check of the batched one."""
    phi, a, v = [rho[0]], [rho[0]], 1 - rho[0] ** 2
    for k in range(1, len(rho)):
        p = (rho[k] - sum(a[j] * rho[k - 1 - j] for j in range(k))) / v
        a = [a[j] - p * a[k - 1 - j] for j in range(k)] + [p]
        phi.append(p)
        v *= 1 - p * p
    return phi


def test_pacf_equals_the_plain_recursion(spark):
    lags = list(range(1, 9))
    table = A.acf(grid_table(spark, {"a": AR, "b": AR[::-1], "flat": [1.0] * 100}), lags)
    rho = {r.lag: r.acf for r in table.where("series_id = 'a'").collect()}
    got = A.pacf(table, 8)
    mine = {r.lag: r.pacf for r in got.where("series_id = 'a'").collect()}
    for k, want in zip(lags, _levinson([rho[k] for k in lags])):
        assert mine[k] == pytest.approx(want, abs=1e-12)
    assert set(r.pacf for r in got.where("series_id = 'flat'").collect()) == {None}
    s = {r.lag: r for r in A.pacf_summary(got, 8).collect()}
    assert (s[1].n_series, s[1].n_dropped) == (2, 1)


def test_pacf_stops_when_the_recursion_is_unstable(spark):
    df = spark.createDataFrame([("E", "x", k, v) for k, v in ((1, 0.9), (2, -0.9), (3, 0.5))],
                               "env string, series_id string, lag int, acf double")
    got = {r.lag: r.pacf for r in A.pacf(df, 3).collect()}
    assert got[1] == 0.9 and got[2] is None and got[3] is None


def test_classical_acf_uses_one_mean_and_train_only(spark):
    got = A.classical_acf(grid_table(spark, {"a": HOLED}), SMALL, {"r1": 1, "r5": 5}).first()
    train = HOLED[:70]
    mean = np.mean([v for v in train if v is not None])
    total = sum((v - mean) ** 2 for v in train if v is not None)
    for name, k in (("r1", 1), ("r5", 5)):
        assert got[name] == pytest.approx(sum((a - mean) * (b - mean) for a, b in _pairs(train, k)) / total)


def test_fill_safety_reports_no_change_without_gaps(spark):
    s = {(r.lag, r.measure): r.p50 for r in P.fill_safety(grid_table(spark, {"a": AR}), SMALL).collect()}
    assert s[1, "fill_change"] == 0 and s[12, "ffill_change"] == 0 and s[1, "obs"] == pytest.approx(s[1, "fill"])


# ------------------------------------------------------------------ strata


def test_burstiness_bound(spark):
    # Half zeros, half ceiling: the largest deviation a mean of 50 allows.
    b = T.burstiness(grid_table(spark, {"extreme": [0.0, 100.0] * 50, "calm": [40.0, 42.0] * 50})).collect()
    r = {x.series_id: x for x in b}
    assert r["extreme"].cv_bound == 1.0 and r["extreme"].bound_ratio == pytest.approx(1.0, abs=0.01)
    assert r["calm"].bound_ratio < 0.05


def test_strata_are_cut_within_each_environment(spark):
    rows = [("A", f"a{i}", float(i), 0.5) for i in range(1, 31)] + [("B", f"b{i}", 0.10 + i / 1000, 0.5) for i in range(1, 31)]
    b = spark.createDataFrame(rows, "env string, series_id string, cv double, bound_ratio double")
    n = {(r.env, r.stratum): r["count"] for r in T.assign_strata(b).groupBy("env", "stratum").count().collect()}
    assert n == {(e, s): 10 for e in "AB" for s in T.STRATA}


def test_value_on_the_threshold_belongs_above(spark):
    b = spark.createDataFrame([("A", "x", 1.0), ("A", "y", 2.0), ("A", "z", 3.0)], "env string, series_id string, cv double")
    t = spark.createDataFrame([("A", 1.0, 3.0)], "env string, t1 double, t2 double")
    assert by_key(T.assign_strata(b, t), "series_id", "stratum") == {"x": "mid", "y": "mid", "z": "high"}


# ------------------------------------------------------------------ distributions


def test_ecdf_is_exact_at_every_point(spark):
    vals = [0.0, 0.004, 0.05, 0.05, 1.0, 33.3, 99.999999, 100.0, 100.0, None]
    xs = D.ecdf_grid(linear=201, log=60)
    got = {r.x: r.share for r in D.ecdf(grid_table(spark, {"a": vals}), xs).collect()}
    seen = [v for v in vals if v is not None]
    assert len(got) == len(xs)
    for x in xs:
        assert got[x] == sum(v <= x for v in seen) / len(seen)


def test_ecdf_and_describe_agree_on_the_median(spark):
    g = grid_table(spark, {"a": AR, "b": AR[::-1]})
    p50 = D.describe(g).first().p50
    below, above = [r.share for r in D.ecdf(g, [p50 - 1e-6, p50 + 1e-6]).orderBy("x").collect()]
    assert below <= 0.5 <= above


def test_ecdf_grid_shows_the_jump_at_the_ceiling():
    xs = D.ecdf_grid()
    assert xs[0] == 0.0 and xs[-1] == 100.0 and 100.0 - 1e-9 in xs and len(xs) > 2800


def test_histogram_closes_the_last_bin(spark):
    h = {r.bin: r.n_in_bin for r in D.histogram(grid_table(spark, {"a": [0, 1.99, 2, 98, 100, None]}), 0, 100, 50).collect()}
    assert (h[0], h[1], h[49], h[10]) == (2, 1, 2, 0) and len(h) == 50


def test_log_histogram_counts_what_lies_in_the_bins(spark):
    rows = [("E", 0.001), ("E", 0.02), ("E", 0.2), ("E", 0.2), ("F", 0.001), ("F", 0.0), ("G", None)]
    got = {(r.env, r.bin): (r.n_in_bin, r.pct) for r in
           D.log_histogram(spark.createDataFrame(rows, "env string, cv double"), -2.0, 0.0, 2, "cv").collect()}
    assert got[("E", 0)] == (1, pytest.approx(100 / 3)) and got[("E", 1)] == (2, pytest.approx(200 / 3))
    assert len(got) == 6 and {got[(e, b)] for e in "FG" for b in (0, 1)} == {(0, None)}


def test_describe(spark):
    d = D.describe(grid_table(spark, {"a": [0, 50, 100, None], "b": [25, 75, 100, None]})).first()
    assert (d.n_series, d.n_points, d.missing_pct) == (2, 8, 25.0)
    assert d.ceiling_pct == pytest.approx(100 * 2 / 6) and d.p50 == 62.5
    assert d["std"] == pytest.approx(np.std([0, 50, 100, 25, 75, 100], ddof=1))


def test_descriptors_come_from_train(spark):
    changed = AR[:70] + [99.0] * 30
    a = D.descriptors(grid_table(spark, {"a": AR}), SMALL).collect()
    b = D.descriptors(grid_table(spark, {"a": changed}), SMALL).collect()
    assert a == b and a[0].log_level == pytest.approx(math.log10(np.mean(AR[:70]) + 0.01))


def test_clusters_separate_obvious_groups_and_accept_new_series(spark):
    rows = []
    for i in range(12):
        g = i % 3
        rows.append(("E", f"s{i}", 2.0 * g + 0.01 * i, -1.0 * g, 0.3 * g, 0.1 * g + 0.001 * i))
    desc = spark.createDataFrame(rows, "env string, series_id string, log_level double, log_cv double, acf_1 double, acf_season double")
    assign = K.fit_clusters(desc, starts=4)
    got = by_key(assign(desc), "series_id", "cluster")
    assert len({got[f"s{i}"] for i in (0, 3, 6, 9)}) == 1 and len(set(got.values())) == 3
    new = desc.limit(1).withColumn("series_id", F.lit("new"))
    assert assign(new).count() == 1 and len(assign.explained) == 2
    shares = K.cluster_shares(assign(desc)).collect()
    assert sum(r.pct for r in shares) == pytest.approx(100)


def test_ratio_to_naive_skips_zero_denominators(spark):
    rows = [("E", 1, "a", "naive", 0.0), ("E", 1, "a", "m", 1.0), ("E", 1, "b", "naive", 2.0), ("E", 1, "b", "m", 1.0)]
    per = spark.createDataFrame(rows, "env string, h int, series_id string, model string, mae double")
    r = D.ratio_to_naive(per).collect()
    assert [(x.series_id, x.ratio) for x in r] == [("b", 0.5)]
    assert D.box_summary(D.ratio_to_naive(per), ["env", "model"], "ratio").first().p50 == 0.5


def test_cluster_shares_read_their_rows_once(spark):
    rows = spark.range(10).select(F.when(F.col("id") < 4, "A").otherwise("B").alias("env"), (F.col("id") % 2).alias("cluster"))
    shares = K.cluster_shares(rows)
    assert shares._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert {tuple(r) for r in shares.collect()} == {("A", 0, 2, 50.0), ("A", 1, 2, 50.0), ("B", 0, 3, 50.0), ("B", 1, 3, 50.0)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_groups_for_clusters_are_dealt_without_another_grid(spark, monkeypatch):
    from checks import queries_series as Q

    own, asked, seen = Q.grid, [], {}
    monkeypatch.setattr(Q, "grid", lambda spark, sf, e: asked.append(e) or own(spark, sf, e))
    groups = Q._groups
    monkeypatch.setattr(Q, "_groups", lambda *a: seen.setdefault("groups", groups(*a)))
    monkeypatch.setattr(Q.K, "fit_clusters", lambda *a, **b: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        Q.descriptor_clusters(spark, SF)
    assert asked.count("C") == 2  # one for the descriptors, one for the groups' means
    assert sorted(seen["groups"].collect()) == sorted(groups(spark, SF).collect())
