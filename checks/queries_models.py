"""Learned models: within an environment, across environments, cross-validated.

Linear models are solved in SQL as well, by elimination, so the whole path from fit
rows to per-series metrics is checked with all features; trees and kernel models are
checked in the unit tests and run here as they are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.fleets import ALL, each, grid, rounded
from checks.queries_series import _GROUPS, _ROWS, BURST, STRATA, _groups
from checks.registry import query
from tidemark.functions.ordered import keep, settle
from tidemark.operators import normalize as N
from tidemark.operators import sampling as R
from tidemark.operators.features import feature_matrix
from tidemark.operators.metrics import with_mase_scale
from tidemark.operators.strata import assign_strata, burstiness
from tidemark.plans import experiment as E
from tidemark.sources.tables import SPECS


def _within_matrix(spark, sf, e, horizons=None):
    scaled = with_mase_scale(grid(spark, sf, e), SPECS[e])
    return feature_matrix(scaled, SPECS[e], horizons, carry=("d",))


def _matrices(spark, sf, envs, modes):
    grids = {e: keep(grid(spark, sf, e)) for e in envs}
    return {(e, m): feature_matrix(grids[e], SPECS[e], mode=m) for e in envs for m in modes}


def _within_sql(models: dict[str, str]) -> str:
    """Per-series test metrics of regressions on all features; ``models`` maps a name to its penalty."""
    ctes, union = [*S.base(), S.scale(), *S.frame(), "fitted AS (SELECT * FROM mat WHERE off + h < n_fit)"], []
    for name, alpha in models.items():
        ctes += S.regression("fitted", ["env", "h"], name, alpha)
        union.append(f"SELECT m.env, m.h, m.series_id, '{name}' AS model, m.y_future AS yt, {S.forecast('m', name)} AS yhat, d FROM mat m"
                     f" JOIN {name} ON m.env = {name}.env AND m.h = {name}.h JOIN scl ON m.env = scl.env AND m.series_id = scl.series_id"
                     " WHERE off >= n_fit AND off + m.h < n")
    ctes.append("lp AS (" + " UNION ALL ".join(union) + ")")
    return S.q([*ctes, S.metrics("lp", "env, h, series_id, model", "lm")],
               "SELECT env, h, series_id, model, n_rows, " + S.rs("mae", "rmse", "smape", "mase", "r2") + " FROM lm")


@query(_within_sql({"lr": "0"}))
def linear_within(spark, sf):
    return rounded(each(lambda e: E.run_within(_within_matrix(spark, sf, e), SPECS[e], {"lr": {}})))


@query(_within_sql({"lr": "0", "ridge": "10"}))
def linear_and_ridge_all_features(spark, sf):
    return rounded(each(lambda e: E.run_within(
        _within_matrix(spark, sf, e), SPECS[e], {"lr": {}, "ridge": {"alpha": 10.0}})))


def _cv_ctes() -> list[str]:
    """``sc`` and ``nt``: score and rows of each penalty, fleet, horizon and fold; ``al`` has the penalties."""
    alphas = "(0, 0.01), (1, 0.1), (2, 1.0), (3, 10.0), (4, 100.0)"
    folds = ", ".join(f"('{e}', {f}, {a}, {b})" for e in ALL for f, a, b in SPECS[e].fold_bounds)
    return [
        *S.base(), S.scale(), *S.frame(),
        f"fb AS (SELECT * FROM (VALUES {folds}) t(env, fold, te, ve))",
        f"al AS (SELECT pos, CAST(alpha AS DOUBLE) AS alpha FROM (VALUES {alphas}) t(pos, alpha))",
        "fitted AS (SELECT m.*, fold, pos, alpha FROM mat m JOIN fb ON m.env = fb.env AND off + h < te, al)",
        *S.regression("fitted", ["env", "h", "fold", "pos", "alpha"], "co", "alpha"),
        f"pr AS (SELECT m.env, m.h, fb.fold, co.pos, m.series_id, m.target AS yt, {S.forecast('m', 'co')} AS yhat FROM mat m JOIN fb"
        " ON m.env = fb.env AND off >= te AND off + h < ve JOIN co ON co.env = m.env AND co.h = m.h AND co.fold = fb.fold)",
        "ps AS (SELECT env, h, fold, pos, series_id, avg(abs(yt - yhat)) AS mae FROM pr GROUP BY ALL)",
        "nt AS (SELECT m.env, m.h, fold, count(*) FILTER (off + h < te) AS n_train, count(*) FILTER (off >= te AND off + h < ve) AS n_val"
        " FROM mat m JOIN fb ON m.env = fb.env GROUP BY ALL)",
        "sc AS (SELECT env, h, fold, pos, median(mae) AS score FROM ps GROUP BY ALL)"]


@query(S.q(_cv_ctes(), "SELECT env, h, 'ridge' AS model, pos AS position, fold, n_train, n_val, " + S.rs("score") + " FROM sc JOIN nt USING (env, h, fold)"))
def ridge_cross_validation(spark, sf):
    """Every published penalty on all features, fleets, horizons and folds."""
    return rounded(each(lambda e: E.cross_validate(feature_matrix(grid(spark, sf, e), SPECS[e]), SPECS[e], "ridge").drop("params")))


@query(S.q([
    *_cv_ctes(),
    "won AS (SELECT env, h, alpha FROM (SELECT env, h, pos, row_number() OVER (PARTITION BY env, h ORDER BY avg(score), pos) AS k FROM sc"
    " GROUP BY env, h, pos) JOIN al USING (pos) WHERE k = 1)",
    "refit AS (SELECT m.*, alpha FROM mat m JOIN won USING (env, h) WHERE off + h < n_fit)",
    *S.regression("refit", ["env", "h", "alpha"], "tuned", "alpha"),
    f"tp AS (SELECT m.env, m.h, m.series_id, m.y_future AS yt, {S.forecast('m', 'tuned')} AS yhat, d FROM mat m JOIN tuned ON m.env = tuned.env"
    " AND m.h = tuned.h JOIN scl ON m.env = scl.env AND m.series_id = scl.series_id WHERE off >= n_fit AND off + m.h < n)",
    S.metrics("tp", "env, h, series_id", "tm")],
    "SELECT env, h, 'ridge' AS model, series_id, n_rows, " + S.rs("mae", "rmse", "smape", "mase", "r2") + " FROM tm"))
def tuned_ridge(spark, sf):
    """Parameters chosen on the folds for each fleet and horizon, used for the one scoring of the test rows."""
    def one(e):
        m = settle(_within_matrix(spark, sf, e), ["h"])
        return E.run_tuned(m, SPECS[e], E.choose(E.cross_validate(m, SPECS[e], "ridge", stored=True)), stored=True)
    return rounded(each(one))


def _transfer_sql(pairs, modes, hs=S.HS, calendars=("on",), start=None, train: str = "TRUE") -> str:
    """Per-series metrics of a linear model fitted on all features of each source; ``train`` may narrow the fit rows ``x`` of N1."""
    ctes = [*(start or [*S.base(sorted({e for p in pairs for e in p})), S.stats()]),
            "pairs AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{t}')" for s, t in pairs) + ") t(source, target))"]
    rows = []
    for m in modes:
        ctes += S.frame(m, f"m{m}", hs=hs)
        ctes.append(f"f{m} AS (SELECT * FROM m{m} x WHERE off + h < n_fit" + (f" AND {train})" if m == "N1" else ")"))
        for cal in calendars:
            c, names = f"c{m}{cal}", tuple(S.FEATURES if cal == "on" else S.FEATURES[:-4])
            ctes += S.regression(f"f{m}", ["env", "h"], c, features=names)
            p = S.forecast("t", c, names)
            yhat = {"N0": p, "N1": f"{p} * t.sd + t.mu", "N2": f"t.y + {p}"}[m]
            rows.append(f"SELECT source, pairs.target AS env, '{m}' AS mode, '{cal}' AS calendar, t.h, t.series_id, t.y_future AS yt, {yhat} AS yhat FROM m{m} t"
                        f" JOIN pairs ON pairs.target = t.env JOIN {c} ON {c}.env = pairs.source AND {c}.h = t.h WHERE t.off >= t.n_fit AND t.off + t.h < t.n")
    ctes.append("tp AS (" + " UNION ALL ".join(rows) + ")")
    ctes.append(S.metrics("tp", "source, env, mode, calendar, h, series_id", "tm", d="CAST(NULL AS DOUBLE)"))
    return S.q(ctes, "SELECT source, env AS target, mode, calendar, h, 'lr' AS model, series_id, n_rows, "
               + S.rs("mae", "rmse", "smape", "mase", "r2") + " FROM tm")


_PAIRS = [(s, t) for s in ALL for t in ALL]


@query(_transfer_sql(_PAIRS, N.MODES))
def linear_transfer(spark, sf):
    """All transfer pairs and the diagonal in all three modes and horizons, by a linear model on all features."""
    return rounded(E.run_transfer(_matrices(spark, sf, ALL, N.MODES), SPECS, _PAIRS, list(N.MODES), {"lr": {}}))


_BOTH_WAYS = [("B", "C"), ("C", "B")]


@query(_transfer_sql(_BOTH_WAYS, ("N0", "N1"), calendars=("on", "off")))
def transfer_without_calendar(spark, sf):
    mats = _matrices(spark, sf, ("B", "C"), ("N0", "N1"))
    return rounded(E.run_transfer(mats, SPECS, _BOTH_WAYS, ["N0", "N1"], {"lr": {}}, True).unionByName(
        E.run_transfer(mats, SPECS, _BOTH_WAYS, ["N0", "N1"], {"lr": {}}, False)))


_SCREENED = ("scr AS (SELECT f.env, f.series_id FROM fleet f JOIN norm ON f.env = norm.env AND f.series_id = norm.series_id JOIN par ON f.env = par.env"
             " WHERE off < n_fit GROUP BY f.env, f.series_id HAVING max(abs(y - mu) / nullif(sd, 0)) > 3.5)")


@query(_transfer_sql([*_BOTH_WAYS, ("C", "C")], ("N1",), start=[*S.base(("B", "C")), S.stats(), _SCREENED],
                     train="NOT EXISTS (SELECT 1 FROM scr WHERE scr.env = x.env AND scr.series_id = x.series_id)"))
def transfer_with_exclusions(spark, sf):
    """N1 with screened series left out of training; every target series is still scored."""
    screen = each(lambda e: N.samuelson_screen(grid(spark, sf, e), SPECS[e]), ("B", "C"))
    screen = screen.withColumn("excluded", F.col("max_abs_z") > 3.5)
    return rounded(E.run_transfer(
        _matrices(spark, sf, ("B", "C"), ("N1",)), SPECS, [*_BOTH_WAYS, ("C", "C")], ["N1"], {"lr": {}}, excluded=screen))


def _halves_sql() -> list[str]:
    """``fleet`` and ``par`` of the pseudo-fleets Cs and Cg in place of those of C."""
    par, *rest = S.base(("C",))
    old = [c.replace("fleet AS (", "whole AS (", 1) if c.startswith("fleet AS (") else c for c in rest]
    copies = " UNION ALL ".join(["SELECT * FROM par_c", *(f"SELECT * REPLACE ('{e}' AS env) FROM par_c" for e in ("Cs", "Cg"))])
    return [par.replace("par AS (", "par_c AS (", 1), f"par AS ({copies})", *old, _GROUPS,
            "sizes AS (SELECT *, count(*) OVER (PARTITION BY env, series_id) AS k FROM grp WHERE env <> 'rest')",
            "fleet AS (SELECT g.env, g.series_id, min(b0) AS b0, f.bucket, f.off, CASE WHEN count(f.y) = max(k) THEN avg(f.y) END AS y"
            " FROM whole f JOIN sizes g ON f.series_id = g.member GROUP BY g.env, g.series_id, f.bucket, f.off)"]


_HALVES = [("Cs", "Cs"), ("Cs", "Cg"), ("Cg", "Cg"), ("Cg", "Cs")]


@query(_transfer_sql(_HALVES, ("N0",), start=_halves_sql()))
def single_vs_grouped_transfer(spark, sf):
    """Half of the suppliers alone, half as group means, in both directions and on their own."""
    g, groups = keep(grid(spark, sf, "C")), _groups(spark, sf)
    single = R.strict_group_mean(g, groups.where(F.col("env") == "Cs"))
    grouped = R.strict_group_mean(g, groups.where(F.col("env") == "Cg"))
    specs = {"Cs": SPECS["C"], "Cg": SPECS["C"]}
    mats = {(e, "N0"): feature_matrix(d, SPECS["C"]) for e, d in (("Cs", single), ("Cg", grouped))}
    return rounded(E.run_transfer(mats, specs, _HALVES, ["N0"], {"lr": {}}))


def _every_candidate(spark, sf, name):
    """Each published candidate of a model on each fleet and horizon, with its parameters; nothing is chosen by these scores."""
    return rounded(E.run_candidates({e: _within_matrix(spark, sf, e) for e in ALL}, SPECS, name))


@query()
def forest_within(spark, sf):
    return _every_candidate(spark, sf, "rf")


@query()
def boosted_within(spark, sf):
    return _every_candidate(spark, sf, "gbt")


@query()
def kernel_within(spark, sf):
    return _every_candidate(spark, sf, "rbf")


_CAPPED = _ROWS.replace("m.series_id, m.off, stratum", "m.series_id, m.off, m.target, stratum").replace("1000", "2000")


@query(S.q([*S.base(("C",)), *S.frame(hs=(1,)), BURST, STRATA, _CAPPED],
           "SELECT stratum, count(*) AS n_rows, " + S.r("avg(target)", "target_mean") + " FROM (SELECT t.*, quota, row_number() OVER"
           " (PARTITION BY t.stratum ORDER BY md5('42|' || series_id || '|' || CAST(off AS VARCHAR)), series_id, off) AS k"
           " FROM tagged t JOIN quota USING (stratum)) WHERE k <= quota GROUP BY stratum"))
def capped_training_rows(spark, sf):
    """Training rows of a capped model: proportional over the CV strata, the same for every run."""
    strata = assign_strata(burstiness(grid(spark, sf, "C")))
    m = feature_matrix(grid(spark, sf, "C"), SPECS["C"], (1,))
    rows = m.where(F.col("off") + F.col("h") < SPECS["C"].fit_bounds[1]).join(
        strata.select("env", "series_id", "stratum"), ["env", "series_id"])
    s = R.proportional_rows(rows, "stratum", ["series_id", "off"], 2000)
    return rounded(s.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("target").alias("target_mean")))


@query(S.q([*S.base(), *S.frame()],
           "SELECT env AS source, env AS target, 'N0' AS mode, 'on' AS calendar, h, model, CAST(1 AS BIGINT) AS n_touched, count(DISTINCT series_id)"
           " AS n_series, count(*) AS n_rows FROM mat, (VALUES ('lr'), ('ridge')) t(model) WHERE off >= n_fit AND off + h < n GROUP BY env, h, model"))
def scored_combinations(spark, sf):
    """Times that each combination is on record, beside the series and test rows that its results have."""
    ledger = E.TestLedger()
    found = each(lambda e: E.run_within(_within_matrix(spark, sf, e), SPECS[e], {"lr": {}, "ridge": {"alpha": 1.0}}, ledger))
    results = found.groupBy("env", "h", "model").agg(F.count(F.lit(1)).alias("n_series"), F.sum("n_rows").alias("n_rows"))
    keys = ["source", "target", "mode", "calendar", "h", "model"]
    results = results.select(F.col("env").alias("source"), F.col("env").alias("target"), F.lit("N0").alias("mode"), F.lit("on").alias("calendar"),
                             "h", "model", "n_series", "n_rows")
    touched = ledger.table(spark).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_touched"))
    return touched.join(results, keys, "full").select(*keys, "n_touched", "n_series", "n_rows")
