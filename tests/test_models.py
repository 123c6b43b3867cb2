import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SMALL, grid_table
from tidemark.operators import normalize as N
from tidemark.operators import splits as V
from tidemark.operators.features import feature_matrix, feature_names
from tidemark.operators.metrics import with_mase_scale
from tidemark.plans import experiment as E
from tidemark.plans import linear as M
from tidemark.plans import models as L


def _walk(seed, n=100, level=50.0):
    rng = random.Random(seed)
    out = [level]
    for _ in range(n - 1):
        out.append(level + 0.7 * (out[-1] - level) + rng.gauss(0, 3))
    return out


DATA = {f"s{i}": _walk(i) for i in range(4)}


@pytest.fixture(scope="module")
def matrix(spark):
    g = with_mase_scale(grid_table(spark, DATA), SMALL)
    return feature_matrix(g, SMALL, (1,), carry=("d",)).persist()


def _numpy(rows, names):
    data = rows.select(*names, "target").collect()
    x = np.array([[r[c] for c in names] for r in data])
    return x, np.array([r["target"] for r in data])


def test_least_squares_equals_closed_form(spark, matrix):
    names = ["lag_1", "lag_2", "diff_1", "roll_mean_3"]
    train, test = V.fit_rows(matrix, SMALL), V.test_rows(matrix, SMALL)
    x, y = _numpy(train, names)
    coef, *_ = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)
    xt, _ = _numpy(test, names)
    got = [r.prediction for r in L.fit("lr", {}, names, train)(test).select("prediction").collect()]
    assert sorted(got) == pytest.approx(sorted(np.c_[xt, np.ones(len(xt))] @ coef), abs=1e-8)


@pytest.mark.parametrize("alpha", [0.01, 1.0, 100.0])
def test_ridge_equals_closed_form(spark, matrix, alpha):
    names = ["lag_1", "lag_3", "diff_1"]
    train = V.fit_rows(matrix, SMALL)
    x, y = _numpy(train, names)
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean()))
    got = sorted(r.prediction for r in L.fit("ridge", {"alpha": alpha}, names, train)(train).select("prediction").collect())
    assert got == pytest.approx(sorted(z @ w + y.mean()), abs=1e-8)


def test_constant_features_do_not_break_the_linear_models(spark, matrix):
    flat = matrix.withColumn("flat", F.lit(1.0))
    for name, p in (("lr", {}), ("ridge", {"alpha": 1.0})):
        out = L.fit(name, p, ["lag_1", "flat"], flat)(flat)
        assert out.where("prediction is null").count() == 0


@pytest.mark.parametrize("name,params", [("rf", {"max_depth": 3, "n_trees": 3}), ("gbt", {"max_depth": 2, "n_trees": 3}),
                                         ("rbf", {"C": 1.0, "n_features": 16})])
def test_other_models_beat_the_mean(spark, matrix, name, params):
    train = V.fit_rows(matrix, SMALL)
    out = L.fit(name, params, ["lag_1", "diff_1", "roll_mean_3"], train)(train)
    s = out.agg(F.avg(F.pow(F.col("prediction") - F.col("target"), 2)).alias("e"), F.var_pop("target").alias("v")).first()
    assert s.e < s.v


def test_registry_names_and_grids():
    assert list(L.BUILDERS) == ["lr", "ridge", "rf", "gbt", "rbf"]
    assert [c["alpha"] for c in L.CANDIDATES["ridge"]] == [0.01, 0.1, 1.0, 10.0, 100.0]
    with pytest.raises(ValueError, match="svm"):
        L.fit("svm", {}, [], None)


def test_cross_validation_never_reads_a_test_row(spark, matrix):
    names = ["lag_1", "diff_1"]
    poisoned = matrix.withColumn("target", F.when(F.col("off") >= 85, F.raise_error(F.lit("test row read"))
                                                  .cast("double")).otherwise(F.col("target")))
    log = E.cross_validate(poisoned, SMALL, "ridge", [{"alpha": 1.0}, {"alpha": 50.0}], names)
    assert log.count() == 10
    best = E.choose(log)
    assert best.count() == 1 and E.chosen_params(best, "E", 1, "ridge")["alpha"] in (1.0, 50.0)
    assert E.parse_params(best).first().params["alpha"] in (1.0, 50.0)
    assert E.chosen_params(best, "E", 1, "rf") == {}


def test_first_candidate_wins_a_tie(spark):
    log = spark.createDataFrame([("E", 1, "m", p, f"p{p}", 0, 10, 2, 1.0) for p in (1, 0, 2)], E.LOG_SCHEMA)
    assert E.choose(log).first().position == 0


def test_tuned_runs_store_the_matrix_once(spark, matrix, monkeypatch):
    stored = []
    monkeypatch.setattr(E, "settle", lambda df, by=None: stored.append(df) or df)
    grid = [{"alpha": 0.1}, {"alpha": 10.0}]
    log = E.cross_validate(matrix, SMALL, "ridge", grid, ["lag_1"], stored=True)
    assert not stored and {(r.fold, r.n_train > 0, r.n_val > 0) for r in log.collect()} == {(i, True, True) for i in range(5)}
    h = matrix.first().h
    chosen = spark.createDataFrame([("E", h, "ridge", 0, '{"alpha": 0.1}', 1.0), ("E", h + 100, "ridge", 1, '{"alpha": 10.0}', 1.0)], E.CHOSEN_SCHEMA)
    assert E.run_tuned(matrix, SMALL, chosen, features=["lag_1"]).count() == 4 and len(stored) == 1


def test_test_rows_are_scored_once(spark, matrix):
    ledger = E.TestLedger()
    out = E.run_within(matrix, SMALL, {"lr": {}}, ledger, features=["lag_1"])
    assert out.count() == 4 and ledger.table(spark).count() == 1
    with pytest.raises(ValueError, match="already scored"):
        E.run_within(matrix, SMALL, {"lr": {}}, ledger, features=["lag_1"])


def _matrices(spark, modes=("N0", "N1", "N2")):
    other = {k: [v * 0.3 for v in vals] for k, vals in DATA.items()}
    grids = {"E": grid_table(spark, DATA), "F": grid_table(spark, other, env="F")}
    return {(e, m): feature_matrix(g, SMALL, (1,), m) for e, g in grids.items() for m in modes}


SPECS = {"E": SMALL, "F": SMALL}


def test_zscore_transfer_is_scale_free(spark):
    """The second environment is the first one scaled: N1 transfers exactly, N0 does not."""
    pairs = [("E", "F"), ("F", "F")]
    out = E.run_transfer(_matrices(spark), SPECS, pairs, ["N0", "N1", "N2"], {"lr": {}}, horizons=(1,),
                         features=["lag_1", "diff_1"])
    mae = {(r.source, r["mode"], r.series_id): r.mae for r in out.collect()}
    for s in DATA:
        assert mae["E", "N1", s] == pytest.approx(mae["F", "N1", s], rel=1e-6)
        assert mae["E", "N0", s] > 1.05 * mae["F", "N0", s]


def test_done_combinations_are_skipped_and_results_go_to_the_sink(spark):
    seen = []
    out = E.run_transfer(_matrices(spark, ("N0",)), SPECS, [("E", "F"), ("E", "E")], ["N0"], {"lr": {}}, horizons=(1,),
                         features=["lag_1"], done={("E", "E", "N0", "on", 1, "lr")}, sink=lambda d: seen.append(d.first()))
    assert out is None and [(r.source, r.target) for r in seen] == [("E", "F")]


def test_a_target_is_scored_once_by_all_of_its_sources(spark):
    """Each source by its own coefficients and horizons, whatever shares the fit and the scan."""
    seen, mats = [], _matrices(spark, ("N0",))
    pairs, done = [("E", "F"), ("F", "F"), ("E", "E")], {("F", "F", "N0", "on", 3, "lr")}
    mats = {k: feature_matrix(grid_table(spark, DATA if k[0] == "E" else {s: [v * 0.3 for v in d] for s, d in DATA.items()}, env=k[0]), SMALL) for k in mats}
    E.run_transfer(mats, SPECS, pairs, ["N0"], {"lr": {}}, features=["lag_1"], done=done, sink=lambda d: seen.append(d.collect()))
    assert [{(r.source, r.target, r.h) for r in t} for t in seen] == [
        {("E", "F", 1), ("E", "F", 3), ("F", "F", 1)}, {("E", "E", 1), ("E", "E", 3)}]
    alone = E.run_transfer(mats, SPECS, [("E", "F")], ["N0"], {"lr": {}}, features=["lag_1"]).collect()
    mae = lambda rows: {(r.h, r.series_id): pytest.approx(r.mae) for r in rows if r.source == "E"}
    assert mae(seen[0]) == mae(alone)


def test_exclusion_changes_training_only(spark):
    mats = _matrices(spark, ("N1",))
    screen = spark.createDataFrame([("E", "s0", True), ("E", "s1", False)], "env string, series_id string, excluded boolean")
    args = (mats, SPECS, [("E", "E")], ["N1"], {"lr": {}})
    a = E.run_transfer(*args, horizons=(1,), features=["lag_1"], excluded=screen)
    b = E.run_transfer(*args, horizons=(1,), features=["lag_1"])
    assert a.count() == b.count() == 4
    assert {r.mae for r in a.collect()} != {r.mae for r in b.collect()}
    led = E.training_ledger(mats["E", "N1"], SMALL, screen).first()
    assert led.n_rows_all == led.n_rows_fit + led.n_rows_excluded and led.n_rows_excluded * 4 == led.n_rows_all


def test_inverse_map(spark):
    df = spark.createDataFrame([(2.0, 10.0, 5.0, 3.0), (2.0, 10.0, 5.0, 0.0)], "p double, y double, mu double, sd double")
    c = [F.col(n) for n in ("p", "y", "mu", "sd")]
    got = df.select(*[N.to_raw_scale(m, *c).alias(m) for m in N.MODES]).collect()
    assert tuple(got[0]) == (2.0, 11.0, 12.0) and got[1].N1 is None


def test_model_queries_run_every_candidate_on_every_fleet_and_horizon(spark, monkeypatch):
    from checks import queries_models as Q

    ran = []

    def run_candidates(matrices, specs, name):
        assert specs is Q.SPECS
        ran.append(name)
        return matrices["A"].unionByName(matrices["B"]).unionByName(matrices["C"])

    monkeypatch.setattr(Q.E, "run_candidates", run_candidates)
    monkeypatch.setattr(Q, "_within_matrix", lambda spark, sf, e, horizons=None: spark.createDataFrame(
        [(e, h) for h in horizons or Q.SPECS[e].horizons], "env string, h int"))
    for name, query in (("rf", Q.forest_within), ("gbt", Q.boosted_within), ("rbf", Q.kernel_within)):
        ran.clear()
        got = {tuple(r) for r in query(spark, "").collect()}
        assert ran == [name] and got == {(e, h) for e in "ABC" for h in (1, 6, 12)}


def _two_horizons(spark):
    g = with_mase_scale(grid_table(spark, DATA), SMALL)
    return feature_matrix(g, SMALL, (1, 2), carry=("d",))


def test_all_candidates_and_horizons_equal_single_fits(spark):
    """What is computed together is what each candidate and horizon gives alone."""
    m, names = _two_horizons(spark), ["lag_1", "diff_1", "roll_mean_3"]
    small = {"ridge": [{"alpha": 0.1}, {"alpha": 30.0}], "rbf": [{"C": 1.0, "n_features": 8}, {"C": 10.0, "n_features": 8}],
             "rf": [{"max_depth": 2, "n_trees": 3}, {"max_depth": 5, "n_trees": 3}],
             "gbt": [{"max_depth": 2, "n_trees": 3}, {"max_depth": 3, "n_trees": 2}, {"max_depth": 3, "n_trees": 4}]}
    for name, grid in small.items():
        together = L.fit_all(name, grid, names, V.fit_rows(m, SMALL), ["env", "h"])(V.test_rows(m, SMALL))
        for h in (1, 2):
            own = m.where(F.col("h") == h)
            for i, params in enumerate(grid):
                one = L.fit(name, params, names, V.fit_rows(own, SMALL))(V.test_rows(own, SMALL))
                key = ["series_id", "off"]
                want = [r[0] for r in one.orderBy(*key).select("prediction").collect()]
                got = [r[0] for r in together.where(F.col("h") == h).orderBy(*key).select(f"p{i}").collect()]
                assert got == pytest.approx(want, rel=1e-9, abs=1e-9) and len(got) > 20, (name, h, params)


def test_folds_from_one_pass_equal_fits_on_each_folds_rows(spark):
    m, names, ends = _two_horizons(spark), ["lag_1", "diff_1", "roll_mean_3"], [e for _, e, _ in SMALL.fold_bounds]
    log = E.cross_validate(m, SMALL, "ridge", [{"alpha": 0.5}, {"alpha": 20.0}], names).collect()
    assert len(log) == 2 * 2 * len(ends) and all(r.n_train > r.n_val > 0 for r in log)
    for fold, end, val in SMALL.fold_bounds:
        for i, alpha in enumerate((0.5, 20.0)):
            own = m.where(F.col("h") == 2)
            found = L.fit("ridge", {"alpha": alpha}, names, own.where(V.in_range(0, end)))(own.where(V.in_range(end, val)))
            want = E.validation_score(found.withColumns({"y_true": F.col("target"), "yhat": F.col("prediction")}), ["h"]).first().score
            (got,) = [r.score for r in log if (r.h, r.fold, r.position) == (2, fold, i)]
            assert got == pytest.approx(want, abs=1e-9)


def test_finished_parts_of_a_search_are_left_out(spark):
    m, names = _two_horizons(spark), ["lag_1"]
    assert {r.h for r in E.cross_validate(m, SMALL, "lr", None, names, done={("E", 1, "lr")}).collect()} == {2}
    done = {("E", 1, "ridge", '{"alpha": 1.0}'), ("E", 2, "lr")}
    assert {r.h for r in E.run_within(m, SMALL, {"ridge": {"alpha": 1.0}}, features=names, done=done).collect()} == {2}
    assert {r.h for r in E.run_within(m, SMALL, {"ridge": {"alpha": 2.0}}, features=names, done=done).collect()} == {1, 2}


def test_tuned_runs_use_each_horizons_own_choice(spark):
    m, names = _two_horizons(spark), ["lag_1", "diff_1"]
    chosen = spark.createDataFrame([("E", 1, "ridge", 0, '{"alpha": 0.5}', 1.0), ("E", 2, "ridge", 1, '{"alpha": 40.0}', 1.0),
                                    ("E", 1, "lr", 0, "{}", 1.0), ("F", 9, "ridge", 2, '{"alpha": 7.0}', 1.0)], E.CHOSEN_SCHEMA)
    ledger = E.TestLedger()
    got = {(r.h, r.model, r.series_id): r.mae for r in E.run_tuned(m, SMALL, chosen, ledger, features=names).collect()}
    want = {}
    for h, model, params in ((1, "ridge", {"alpha": 0.5}), (2, "ridge", {"alpha": 40.0}), (1, "lr", {})):
        for r in E.run_within(m.where(F.col("h") == h), SMALL, {model: params}, features=names).collect():
            want[h, model, r.series_id] = r.mae
    assert got == pytest.approx(want) and len(ledger.touched) == 3
    assert E.run_tuned(m, SMALL, chosen.where("env = 'F'"), features=names) is None


def test_moments_merge(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(1e6, 1, (300, 4))
    a, b = M.Moments.of(x[:10]), M.Moments.of(x[10:])
    whole, got = M.Moments.of(x), M.Moments.unpacked((a + b).packed(), 4)
    assert got.n == 300 and np.allclose(got.mean, whole.mean) and np.allclose(got.co, whole.co)
    w, _ = M.Moments.of(np.c_[x[:, 0], x[:, 0], x[:, 1]]).ridge(0)
    assert w[0] == pytest.approx(w[1])  # dependent features share


def test_robust_regression_is_that_of_the_other_solver(spark):
    """The same objective minimised by Spark's own solver."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 2))
    y = np.sin(x[:, 0]) + 0.5 * x[:, 1] + 0.1 * draw.normal(size=400) + (draw.random(400) < 0.1) * 8
    rows = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, target double")
    found = M.KernelRegression(["a", "b"], [], 12, 42).fit(rows, [1.0])
    phi = found.lift("", x)
    lifted = spark.createDataFrame([(*map(float, p), float(t)) for p, t in zip(phi, y, strict=True)], ", ".join(f"f{i} double" for i in range(12)) + ", target double")
    ready = VectorAssembler(inputCols=lifted.columns[:-1], outputCol="features").transform(lifted)
    other = LinearRegression(labelCol="target", loss="huber", epsilon=1.35, maxIter=500, tol=1e-12, regParam=1 / 400).fit(ready)
    w, scale = found.found["", 0]
    assert np.abs(phi @ w[:-1] + w[-1] - (phi @ other.coefficients.toArray() + other.intercept)).max() < 5e-3
    assert scale == pytest.approx(other.scale, rel=1e-3)


def test_level_reference_of_two_runs_in_one_scan(spark):
    from tidemark.operators.splits import fit_rows, in_range, test_rows
    from tidemark.plans.transfer import level_reference

    m = _matrices(spark, ("N0",))
    rows = m["E", "N0"].unionByName(m["F", "N0"])
    fit, test, train = fit_rows(rows, SMALL), test_rows(rows, SMALL), rows.where(in_range(*SMALL.bounds["train"]))
    both = level_reference(fit.withColumn("run", F.lit("first")).unionByName(train.withColumn("run", F.lit("again"))), test, runs=True)
    key = lambda r: (r.source, r.target, r["mode"], r.h, r.series_id)
    for run, alone in (("first", fit), ("again", train)):
        assert {key(r): r.mae for r in both.where(F.col("run") == run).collect()} == {
            key(r): pytest.approx(r.mae) for r in level_reference(alone, test).collect()}


def test_level_reference_of_named_pairs(spark):
    """A source's mean target on every test row of its target; named pairs are a part of all pairs."""
    from tidemark.plans.transfer import level_reference

    rows = [m.withColumn("mode", F.lit("N0")) for m in _matrices(spark, ("N0",)).values()]
    both = rows[0].unionByName(rows[1])
    fit, test = V.fit_rows(both, SMALL), V.test_rows(both, SMALL)
    key = lambda r: (r.source, r.target, r.h, r.series_id)
    every = {key(r): r.mae for r in level_reference(fit, test).collect()}
    named = {key(r): r.mae for r in level_reference(fit, test, [("E", "F"), ("F", "F"), ("E", "F")]).collect()}
    assert {k[:2] for k in every} == {("E", "E"), ("E", "F"), ("F", "E"), ("F", "F")}
    assert named == pytest.approx({k: v for k, v in every.items() if k[:2] in {("E", "F"), ("F", "F")}}) and named
    level = fit.where("env = 'E'").agg(F.avg("target")).first()[0]
    want = test.where("env = 'F' AND series_id = 's1'").agg(F.avg(F.abs(F.col("y_future") - level))).first()[0]
    assert named["E", "F", 1, "s1"] == pytest.approx(want)


def test_cosines_by_table():
    from tidemark.plans.linear import TURN, cosines

    x = np.append(np.random.default_rng(2).normal(size=5000) * 20, [0.0, np.nan, np.inf])
    with np.errstate(invalid="ignore"):
        assert np.allclose(cosines(x * TURN / (2 * np.pi)), np.cos(x), rtol=0, atol=3e-14, equal_nan=True)


def test_a_pass_of_the_kernel_model_multiplies_all_rows_once(spark, monkeypatch):
    """Plain sums are taken in the first pass only; later ones send the shares of rows beyond WIDTH."""
    from tidemark.plans import linear as M

    rows = spark.createDataFrame([(float(i % 17), float(i % 5), float(i % 17) + (50.0 if i % 29 == 0 else 0.0)) for i in range(400)], "a double, b double, target double")
    seen, one = [], M.KernelRegression._pass
    monkeypatch.setattr(M.KernelRegression, "_pass", lambda self, r, todo, whole: seen.append(len(whole)) or one(self, r, todo, whole))
    M.KernelRegression(["a", "b"], [], 12, 42).fit(rows, [1.0, 10.0])
    assert len(seen) > 2 and seen[0] == 0 and set(seen[1:]) == {1}
