"""Features, normalisation, splits, baselines, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.fleets import baseline_metrics, each, grid, matrix, regular, rounded, scaled_matrix
from checks.queries_grid import prof_sql
from checks.registry import query
from tidemark.functions.ordered import keep
from tidemark.operators import catalog as C
from tidemark.operators import features as X
from tidemark.operators import metrics as M
from tidemark.operators import normalize as N
from tidemark.operators import splits as V
from tidemark.operators.baselines import baseline_predictions, seasonal_lookup
from tidemark.plans import quality as Q
from tidemark.plans.transfer import raw_scale_predictions
from tidemark.sources.tables import SPECS

_MAT = ["env", "series_id", "bucket", "h", *X.feature_names(SPECS["A"]), "target"]
# Means of a few two-decimal values often end in a 5 at the seventh place.
_DIGITS = 7
_MAT_SQL = "SELECT env, series_id, bucket, h, " + S.rs(*S.FEATURES, "target", digits=_DIGITS)


@query(S.q([*S.base(("A", "B")), *S.frame(hs=(1,), valid_only=False)],
           _MAT_SQL + ", coalesce(n25 = 25 AND target IS NOT NULL, FALSE) AS valid FROM mat"))
def feature_frame(spark, sf):
    return rounded(each(lambda e: X.feature_frame(grid(spark, sf, e), SPECS[e], (1,)), ("A", "B")).select(
        *_MAT, "valid"), _DIGITS)


@query(S.q([*S.base(), *S.frame()], _MAT_SQL + " FROM mat"))
def feature_matrix(spark, sf):
    return rounded(each(lambda e: matrix(spark, sf, e)).select(*_MAT), _DIGITS)


@query(S.q([*S.base(), S.stats(), *S.frame("N1", hs=(6,))], _MAT_SQL + ", " + S.rs("mu", "sd", digits=_DIGITS) + " FROM mat"))
def feature_matrix_zscore(spark, sf):
    return rounded(each(lambda e: matrix(spark, sf, e, "N1", (6,))).select(*_MAT, "mu", "sd"), _DIGITS)


@query(S.q([*S.base(), *S.frame("N2", hs=(12,))], _MAT_SQL + " FROM mat"))
def feature_matrix_difference(spark, sf):
    return rounded(each(lambda e: matrix(spark, sf, e, "N2", (12,))).select(*_MAT), _DIGITS)


@query(S.q([*S.base(), *S.frame()], " UNION ALL ".join(
    f"SELECT env, h, '{c}' AS feature, " + S.r(f"avg({c})", "mean") + ", " + S.r(f"stddev_samp({c})", "std")
    + " FROM mat GROUP BY env, h" for c in [*S.FEATURES, "target"])))
def feature_fingerprint(spark, sf):
    return rounded(each(lambda e: Q.feature_fingerprint(matrix(spark, sf, e), SPECS[e], ["env", "h"])))


@query(S.q([*prof_sql(), *S.frame(hs=(1, 6, 12)),
            "keptm AS (SELECT m.env, m.h, count(*) AS n FROM mat m JOIN prof p ON m.env = p.env"
            " AND m.series_id = p.series_id WHERE p.reject_reason = '' GROUP BY m.env, m.h)",
            "said AS (" + " UNION ALL ".join(
                f"SELECT env, {h} AS h, CAST(sum(valid_rows_h{h}) AS BIGINT) AS n_catalog FROM prof"
                f" WHERE reject_reason = '' GROUP BY env" for h in (1, 6, 12)) + ")"],
           "SELECT said.env, said.h, n_catalog, coalesce(n, 0) AS n_matrix, n_catalog = coalesce(n, 0) AS agrees"
           " FROM said LEFT JOIN keptm ON said.env = keptm.env AND said.h = keptm.h"))
def matrix_vs_catalog(spark, sf):
    def one(e):
        reg = regular(spark, sf, e)
        prof = C.profile(reg, SPECS[e])
        m = X.feature_matrix(C.processed(reg, prof), SPECS[e])
        return X.reconcile_rows(m, prof, SPECS[e])
    return each(one)


@query(S.q([*S.base(), S.stats()],
           "SELECT env, m.mode, series_id, CASE WHEN m.mode = 'N1' THEN round(mu, 6) END AS mu,"
           " CASE WHEN m.mode = 'N1' THEN round(sd, 6) END AS sd, n_train AS n_rows_train"
           " FROM norm, (VALUES ('N0'), ('N1'), ('N2')) m(mode)"))
def normalisation_table(spark, sf):
    return rounded(each(lambda e: N.normalisation_table(grid(spark, sf, e), SPECS[e])))


@query(S.q([*S.base(), S.stats()],
           "SELECT env, count(*) AS n_series, count(*) FILTER (sd > 0) AS n_usable, CAST(sum(n_train) AS BIGINT)"
           " AS n_points FROM norm GROUP BY env"))
def zscore_usable(spark, sf):
    return each(lambda e: N.train_stats(grid(spark, sf, e), SPECS[e])).groupBy("env").agg(
        F.count(F.lit(1)).alias("n_series"), F.count_if("usable").alias("n_usable"),
        F.sum("n_train").alias("n_points"))


@query(S.q([S.params(S.ALL)],
           "SELECT env, i.name AS invariant, CAST(i.lim AS DOUBLE) AS \"limit\", CAST(0 AS DOUBLE) AS max_error,"
           " TRUE AS holds FROM par, (VALUES ('naive_n0_n1', 1e-9), ('ma6_n0_n1', 1e-9), ('naive_n0_n2', 0.0)) i(name, lim)"))
def round_trip_invariants(spark, sf):
    d = each(lambda e: N.invariants(grid(spark, sf, e), SPECS[e]))
    return d.withColumn("max_error", F.round("max_error", 9) + 0.0)


_SCREEN = ("screen AS (SELECT f.env, f.series_id, max(norm.n_train) AS n_train, max(mu) AS mu, max(sd) AS sd,"
           " max(abs(y - mu) / nullif(sd, 0)) FILTER (off < n_fit) AS max_abs_z,"
           " max(abs(y - mu) / nullif(sd, 0)) FILTER (off < par.n_train) AS z_train"
           " FROM fleet f JOIN norm ON f.env = norm.env AND f.series_id = norm.series_id"
           " JOIN par ON f.env = par.env GROUP BY f.env, f.series_id)")


@query(S.q([*S.base(), S.stats(), _SCREEN],
           "SELECT env, series_id, n_train, " + S.rs("mu", "sd", "max_abs_z") + ", "
           + S.r("(n_train - 1) / sqrt(n_train)", "bound") + ", coalesce(sd > 0 AND max_abs_z > (n_train - 1) / sqrt(n_train), FALSE)"
           " AS excluded, CASE WHEN sd > 0 AND z_train > (n_train - 1) / sqrt(n_train) * (1 + 1e-12) THEN 1 ELSE 0 END"
           " AS n_violations FROM screen"))
def outlier_screen(spark, sf):
    return rounded(each(lambda e: N.samuelson_screen(grid(spark, sf, e), SPECS[e])))


@query(S.q([*S.base(), *S.frame()], f"SELECT env, h, {S.SPLIT} AS split, count(*) AS n_rows FROM mat GROUP BY ALL"))
def split_rows(spark, sf):
    return V.split_counts(each(lambda e: V.with_split(matrix(spark, sf, e), SPECS[e])))


def _folds() -> str:
    rows = []
    for e in S.ALL:
        for fold, a, b in SPECS[e].fold_bounds:
            rows.append(f"('{e}', {fold}, 'train', 0, {a})")
            rows.append(f"('{e}', {fold}, 'val', {a}, {b})")
    return "folds AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(env, fold, role, lo, hi))"


@query(S.q([*S.base(), *S.frame(), _folds()],
           "SELECT mat.env, h, fold, role, count(*) AS n_rows FROM mat JOIN folds ON mat.env = folds.env"
           " AND off >= lo AND off + h < hi GROUP BY ALL"))
def rolling_folds(spark, sf):
    return each(lambda e: V.fold_counts(V.with_folds(matrix(spark, sf, e), SPECS[e])))


@query(S.q([*S.base(), *S.frame()],
           "SELECT env, h, count(*) FILTER (off + h < n_fit) AS n_fit_rows,"
           " count(*) FILTER (off >= n_fit AND off + h < n) AS n_test_rows FROM mat GROUP BY env, h"))
def fit_and_test_rows(spark, sf):
    def one(e):
        m = matrix(spark, sf, e)
        fit = V.fit_rows(m, SPECS[e]).groupBy("env", "h").agg(F.count(F.lit(1)).alias("n_fit_rows"))
        test = V.test_rows(m, SPECS[e]).groupBy("env", "h").agg(F.count(F.lit(1)).alias("n_test_rows"))
        return fit.join(test, ["env", "h"])
    return each(one)


@query(S.q([*S.base(), S.scale()], "SELECT env, series_id, " + S.rs("d") + " FROM scl"))
def mase_scale(spark, sf):
    return rounded(each(lambda e: M.mase_scale(grid(spark, sf, e), SPECS[e])))


PER = [*S.base(), *S.frame(), *S.baseline_preds(), S.metrics("pred", "env, h, model, split, series_id")]
PER_TEST = [*S.base(), *S.frame(), *S.baseline_preds(),
            S.metrics("pred", "env, h, model, series_id", where="split = 'test'")]
_METRICS = S.rs("mae", "rmse", "smape", "mase", "r2")


@query(S.q(PER, "SELECT env, h, model, split, series_id, n_rows, " + _METRICS + " FROM per"))
def baseline_series_metrics(spark, sf):
    return rounded(each(lambda e: baseline_metrics(spark, sf, e, split=None)))


@query(S.q([*PER, S.unpivot("per", "env, h, model, split"), S.aggregate("env, h, model, split")],
           "SELECT env, h, model, split, metric, " + S.rs("p25", "p50", "p75", "iqr") + ", n_series, n_excluded FROM agg"))
def baseline_table(spark, sf):
    def one(e):
        per = baseline_metrics(spark, sf, e, split=None)
        return M.aggregate_metrics(per, ["env", "h", "model", "split"], M.series_totals(grid(spark, sf, e)))
    return rounded(each(one))


@query(S.q([*PER, "sizes AS (SELECT env, h, split, count(*) AS n_split FROM mats GROUP BY ALL)"],
           "SELECT per.env, per.h, per.split, model, CAST(sum(n_rows) AS BIGINT) AS n_used, max(n_split) AS n_split, "
           + S.r("100 * (1 - sum(n_rows) / max(n_split))", "dropped_pct")
           + " FROM per JOIN sizes ON per.env = sizes.env AND per.h = sizes.h AND per.split = sizes.split"
           " GROUP BY per.env, per.h, per.split, model"))
def rows_used(spark, sf):
    def one(e):
        sizes = V.split_counts(scaled_matrix(spark, sf, e))
        return M.rows_used(baseline_metrics(spark, sf, e, split=None), sizes, ["env", "h", "split"])
    return rounded(each(one))


@query(S.q([*S.base(), *S.frame(hs=(6,)), S.season_values()],
           "SELECT m.env, m.series_id, m.bucket, " + S.r("seas.y_season", "y_season") + " FROM mat m LEFT JOIN seas"
           " ON m.env = seas.env AND m.series_id = seas.series_id AND m.bucket = seas.bucket"))
def seasonal_lookup_join(spark, sf):
    def one(e):
        g = grid(spark, sf, e)
        rows = X.feature_matrix(g, SPECS[e], (6,)).select("env", "series_id", "bucket")
        return seasonal_lookup(rows, g, SPECS[e].season)
    return rounded(each(one))


@query(S.q([*S.base(), *S.frame(), *S.baseline_preds(), _folds(),
            "fp AS (SELECT pred.*, fold FROM pred JOIN folds ON pred.env = folds.env AND role = 'val' AND off >= lo"
            " AND off + h < hi)",
            S.metrics("fp", "env, h, model, fold, series_id", "fper"),
            "sc AS (SELECT env, h, model, fold, median(mae) AS score FROM fper GROUP BY ALL)",
            "mean AS (SELECT env, h, model, avg(score) AS score FROM sc GROUP BY ALL)"],
           "SELECT env, h, arg_min(model, score) AS best, " + S.r("min(score)", "score") + " FROM mean GROUP BY env, h"))
def fold_selected_baseline(spark, sf):
    """Rolling-origin scores of the baselines and the winner per (env, h)."""
    def one(e):
        p = baseline_predictions(scaled_matrix(spark, sf, e), SPECS[e])
        p = V.with_folds(p, SPECS[e]).where(F.col("role") == "val")
        s = M.validation_score(p, ["env", "h", "model", "fold"])
        mean = s.groupBy("env", "h", "model").agg(F.avg("score").alias("score"))
        best = F.min_by(F.struct("model", "score"), F.struct("score", "model")).alias("b")
        return mean.groupBy("env", "h").agg(best).select("env", "h", F.col("b.model").alias("best"), "b.score")
    return rounded(each(one))


def _inverse_sql() -> str:
    parts = []
    ctes = [*S.base(), S.stats(), S.scale()]
    for mode in ("N0", "N1", "N2"):
        ctes += S.frame(mode, f"m{mode}", hs=(6,))
        pred = {"N0": "lag_1 + diff_1", "N1": "(lag_1 + diff_1) * sd + mu", "N2": "y + 0"}[mode]
        parts.append(f"SELECT env, series_id, '{mode}' AS mode, y_future AS yt, {pred} AS yhat FROM m{mode}"
                     " WHERE off >= n_fit AND off + h < n")
    ctes += ["ip AS (" + " UNION ALL ".join(parts) + ")", S.metrics("ip", "env, mode, series_id", "ips", d="1")]
    return S.q(ctes, "SELECT env, mode, count(*) AS n_series, " + S.r("median(mae)", "mae_p50") + ", "
               + S.r("avg(rmse)", "rmse_mean") + " FROM ips GROUP BY env, mode")


@query(_inverse_sql())
def inverse_mapped_naive(spark, sf):
    """The naive forecast in each mode's scale, mapped back: the same error in all modes."""
    def one(e):
        out = None
        for mode in N.MODES:
            m = V.test_rows(matrix(spark, sf, e, mode, (6,)), SPECS[e])
            m = m.withColumn("prediction", F.lit(0.0) if mode == "N2" else F.col("lag_1") + F.col("diff_1"))
            p = M.per_series_metrics(raw_scale_predictions(m, mode), ["env", "mode", "series_id"])
            out = p if out is None else out.unionByName(p)
        out = keep(out)
        med = M.quantiles(out, ["env", "mode"], "mae", {"mae_p50": 0.5}).withColumnRenamed("n", "n_series")
        return med.join(out.groupBy("env", "mode").agg(F.avg("rmse").alias("rmse_mean")), ["env", "mode"])
    return rounded(each(one))


# ------------------------------------------------------------------ gates


def _all_ok(names, src: str, keys: str = "env, h") -> str:
    rows = ", ".join(f"('{n}')" for n in names)
    return (f"SELECT {keys}, c.chk AS \"check\", count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad, 'ok' AS status"
            f" FROM {src}, (VALUES {rows}) c(chk) GROUP BY {keys}, c.chk")


@query(S.q([*S.base(), *S.frame()], " UNION ALL ".join(
    f"SELECT env, h, '{c}' AS \"check\", count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_bad,"
    f" CASE WHEN count(*) FILTER ({c} IS NULL) > 0 THEN 'fail' ELSE 'ok' END AS status FROM mat GROUP BY env, h"
    for c in [*S.FEATURES, "target"])))
def gate_no_nulls(spark, sf):
    return each(lambda e: Q.null_counts(matrix(spark, sf, e), [*X.feature_names(SPECS[e]), "target"], ["env", "h"]))


@query(S.q([*S.base(), *S.frame()], "SELECT env, series_id, h, min(off) AS first_off, CASE WHEN min(off) < 24"
           " THEN 'fail' ELSE 'ok' END AS status FROM mat GROUP BY env, series_id, h"))
def gate_first_row(spark, sf):
    return each(lambda e: Q.first_valid_rows(matrix(spark, sf, e), SPECS[e]))


@query(S.q([*S.base(), *S.frame()], _all_ok(
    ("lag_1_inside_roll_6", "mean_6_inside_range", "width_12_contains_6", "deviation_not_negative"), "mat")))
def gate_rolling(spark, sf):
    return each(lambda e: Q.rolling_gate(matrix(spark, sf, e), ["env", "h"]))


@query(S.q([*S.base(), *S.frame()], "SELECT env, h, " + S.r(
    "avg(CASE WHEN roll_min_6 - 1e-9 <= lag_1 + diff_1 AND lag_1 + diff_1 <= roll_max_6 + 1e-9 THEN 1.0 ELSE 0.0 END)",
    "share_inside") + ", 'ok' AS status FROM mat GROUP BY env, h"))
def gate_shift(spark, sf):
    return rounded(each(lambda e: Q.shift_gate(matrix(spark, sf, e), ["env", "h"])))


@query(S.q([*S.base(), *S.frame()], _all_ok(X.CALENDAR, "mat")))
def gate_calendar(spark, sf):
    return each(lambda e: Q.calendar_gate(matrix(spark, sf, e), SPECS[e], ["env", "h"]))


@query(S.q([*S.base(), S.stats(), *S.frame("N1", "m1"), *S.frame("N0", "m0"),
            "bothm AS (SELECT m0.env FROM m0 JOIN m1 USING (env, series_id, bucket, h))"],
           _all_ok(X.CALENDAR, "bothm", "env")))
def gate_calendar_modes(spark, sf):
    return each(lambda e: Q.calendar_across_modes(matrix(spark, sf, e), matrix(spark, sf, e, "N1")))


@query(S.q(PER, _all_ok(("rmse_not_below_mae", "smape_in_0_200", "r2_at_most_1", "mase_not_negative"),
                        "per", "env, h, model")))
def gate_metric_identities(spark, sf):
    return each(lambda e: Q.metric_identities(baseline_metrics(spark, sf, e, split=None), ["env", "h", "model"]))


@query(S.q([*PER_TEST, S.unpivot("per", "env, h, model"), S.aggregate("env, h, model")],
           _all_ok(("quartiles_ordered", "iqr_is_difference", "counts_not_negative"), "agg", "env, h, model")))
def gate_aggregate_identities(spark, sf):
    def one(e):
        a = M.aggregate_metrics(baseline_metrics(spark, sf, e), ["env", "h", "model"], M.series_totals(grid(spark, sf, e)))
        return Q.aggregate_identities(a, ["env", "h", "model"])
    return each(one)


@query(S.q([S.params(S.ALL)], "SELECT env, CAST(1 AS BIGINT) AS n_totals, 'ok' AS status FROM par"))
def gate_constant_total(spark, sf):
    def one(e):
        a = M.aggregate_metrics(baseline_metrics(spark, sf, e), ["env", "h", "model"], M.series_totals(grid(spark, sf, e)))
        return Q.constant_total(a, "env")
    return each(one)


@query(S.q([*S.base(), *S.frame(),
            "tot AS (SELECT env, count(DISTINCT series_id) AS n_total FROM fleet GROUP BY env)",
            f"pc AS (SELECT env, h, count(*) AS n_rows FROM mat WHERE {S.SPLIT} = 'purged' GROUP BY env, h)"],
           "SELECT pc.env, h, n_rows, n_total, CASE WHEN n_rows BETWEEN 1 AND 2 * h * n_total THEN 'ok' ELSE 'fail' END"
           " AS status FROM pc JOIN tot ON pc.env = tot.env"))
def gate_purge(spark, sf):
    def one(e):
        return Q.purge_gate(V.split_counts(V.with_split(matrix(spark, sf, e), SPECS[e])),
                            M.series_totals(grid(spark, sf, e)))
    return each(one)


@query(S.q([*S.base(), S.stats(), *S.frame("N0", "m0"), *S.frame("N1", "m1"), *S.frame("N2", "m2")],
           "SELECT * , \"N1\" = \"N0\" AS n1_equals_n0, \"N0\" - \"N2\" AS n2_lost FROM (SELECT a.env, a.h, a.n AS \"N0\","
           " b.n AS \"N1\", c.n AS \"N2\" FROM (SELECT env, h, count(*) AS n FROM m0 GROUP BY env, h) a"
           " JOIN (SELECT env, h, count(*) AS n FROM m1 GROUP BY env, h) b ON a.env = b.env AND a.h = b.h"
           " JOIN (SELECT env, h, count(*) AS n FROM m2 GROUP BY env, h) c ON a.env = c.env AND a.h = c.h)"))
def gate_mode_counts(spark, sf):
    return each(lambda e: Q.mode_counts({m: matrix(spark, sf, e, m) for m in N.MODES}))


@query(S.q([*S.base(), *S.frame("N2", "m2")],
           "SELECT env, h, count(*) AS n_law, count(*) AS n_matrix, 'ok' AS status FROM m2 GROUP BY env, h"))
def gate_difference_rows(spark, sf):
    return each(lambda e: Q.n2_row_law(grid(spark, sf, e), matrix(spark, sf, e, "N2"), SPECS[e]))


@query(S.q([*S.base(), *S.frame("N2", "m2")], _all_ok(("target_is_h_step_change",), "m2")))
def gate_difference_target(spark, sf):
    return each(lambda e: Q.n2_target_gate(matrix(spark, sf, e, "N2"), ["env", "h"]))


@query(S.q([*S.base(), S.stats(), *S.frame("N1", "m1")],
           "SELECT env, count(DISTINCT series_id) AS n_series, CAST(0 AS BIGINT) AS n_bad, 'ok' AS status FROM m1 GROUP BY env"))
def gate_recovered_parameters(spark, sf):
    def one(e):
        g = grid(spark, sf, e)
        return Q.recovered_parameters(matrix(spark, sf, e), matrix(spark, sf, e, "N1"),
                                      N.normalisation_table(g, SPECS[e]))
    return each(one)


@query(S.q([*S.base(), S.stats(), *S.frame("N1", "m1")], _all_ok(
    ("lag_1", "value_at_t", "deepest_lag", "target", "target_present_in_raw"), "m1")))
def gate_zscore_recheck(spark, sf):
    def one(e):
        g = grid(spark, sf, e)
        return Q.normalised_recheck(g, matrix(spark, sf, e, "N1"), N.train_stats(g, SPECS[e]), SPECS[e])
    return each(one)
