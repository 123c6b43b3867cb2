"""Strata, samples, groups, autocorrelation, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.fleets import baseline_metrics, each, grid, matrix, rounded
from checks.queries_features import PER_TEST
from checks.registry import query
from tidemark.functions.ordered import keep
from tidemark.operators import acf as A
from tidemark.operators import distribution as D
from tidemark.operators import metrics as M
from tidemark.operators import sampling as R
from tidemark.operators import strata as T
from tidemark.plans import clusters as K
from tidemark.plans import quality as Q
from tidemark.plans import rank_tests as H
from tidemark.plans.transfer import constant_level
from tidemark.sources.logs import machine_means
from tidemark.sources.tables import FLEETS, SPECS

BURST = ("burst AS (SELECT *, sd / mean AS cv, sqrt((100 - mean) / mean) AS cv_bound, sd / mean / sqrt((100 - mean) / mean)"
         " AS bound_ratio FROM (SELECT env, series_id, avg(y) AS mean, stddev_samp(y) AS sd, count(y) AS n_points"
         " FROM fleet GROUP BY env, series_id))")
STRATA = ("cut AS (SELECT env, quantile_cont(cv, 1.0 / 3) AS t1, quantile_cont(cv, 2.0 / 3) AS t2 FROM burst GROUP BY env), "
          "strata AS (SELECT b.*, CASE WHEN cv < t1 THEN 'low' WHEN cv < t2 THEN 'mid' ELSE 'high' END AS stratum"
          " FROM burst b JOIN cut ON b.env = cut.env)")


@query(S.q([*S.base(), BURST], "SELECT env, series_id, " + S.rs("mean") + ", " + S.r("sd", "std") + ", n_points, "
           + S.rs("cv", "cv_bound", "bound_ratio") + " FROM burst"))
def burstiness(spark, sf):
    return rounded(each(lambda e: T.burstiness(grid(spark, sf, e))))


@query(S.q([*S.base(), BURST,
            "b AS (SELECT env, count(cv) AS n_series, " + ", ".join(
                f"quantile_cont(cv, {p / 100}) AS cv_p{p}" for p in (5, 25, 50, 75, 95))
            + ", median(bound_ratio) AS bound_ratio_p50, min(cv) AS cv_min, max(cv) AS cv_max, avg(cv) AS cv_mean,"
            " 100 * avg(CASE WHEN bound_ratio >= 0.8 THEN 1.0 ELSE 0 END) AS near_bound_pct,"
            " count(*) FILTER (bound_ratio > 1.0001) AS bound_violations FROM burst GROUP BY env)"],
           "SELECT env, n_series, bound_violations, " + S.rs(
               "cv_p5", "cv_p25", "cv_p50", "cv_p75", "cv_p95", "bound_ratio_p50", "cv_min", "cv_max", "cv_mean",
               "near_bound_pct") + ", " + S.r("cv_p75 - cv_p25", "cv_iqr") + ", "
           + S.r("(cv_p75 - cv_p25) / cv_p50", "cv_iqr_over_p50") + ", "
           + S.r("100 * (cv_mean / cv_p50 - 1)", "mean_vs_p50_pct") + " FROM b"))
def burstiness_summary(spark, sf):
    return rounded(T.burstiness_summary(each(lambda e: T.burstiness(grid(spark, sf, e)))))


def _rank(c: str) -> str:
    return (f"rank() OVER (PARTITION BY env ORDER BY {c})"
            f" + (count(*) OVER (PARTITION BY env, {c}) - 1) / 2.0")


@query(S.q([*S.base(), BURST, f"rk AS (SELECT env, {_rank('cv')} AS rx, {_rank('mean')} AS ry FROM burst)"],
           "SELECT env, " + S.r("corr(rx, ry)", "rho") + ", count(*) AS n_series FROM rk GROUP BY env"))
def level_vs_burstiness(spark, sf):
    b = each(lambda e: T.burstiness(grid(spark, sf, e)))
    return rounded(H.spearman(b, ["env"], "cv", "mean").drop("p"))


@query(S.q([*S.base(), BURST, f"rk AS (SELECT env, {_rank('cv')} AS rx, {_rank('mean')} AS ry FROM burst)",
            "co AS (SELECT env, corr(rx, ry) AS rho, count(*) AS n_series FROM rk GROUP BY env)",
            "te AS (SELECT *, n_series - 2 AS dof, rho * sqrt(CASE WHEN n_series > 1 THEN n_series - 2.0 END / nullif(1 - rho * rho, 0)) AS t FROM co)"],
           "SELECT env, " + S.r("rho") + ", n_series, " + S.r(S.student("t", "dof"), "p") + " FROM te"))
def level_vs_burstiness_p(spark, sf):
    """The same correlation with its p-value; SQL integrates Student's density."""
    return rounded(H.spearman(each(lambda e: T.burstiness(grid(spark, sf, e))), ["env"], "cv", "mean"))


@query(S.q([*S.base(), BURST, STRATA], "SELECT env, series_id, stratum, " + S.rs("cv", "bound_ratio") + " FROM strata"))
def cv_strata(spark, sf):
    return rounded(T.assign_strata(each(lambda e: T.burstiness(grid(spark, sf, e)))).select(
        "env", "series_id", "stratum", "cv", "bound_ratio"))


@query(S.q([*PER_TEST, BURST, STRATA,
            "ps AS (SELECT per.*, stratum, cv, bound_ratio FROM per JOIN strata USING (env, series_id))",
            S.unpivot("ps", "env, h, model, stratum, cv, bound_ratio")],
           "SELECT env, h, model, stratum, metric, " + ", ".join(
               S.r(f"quantile_cont(value, {p / 100})", f"p{p}") for p in (25, 50, 75))
           + ", " + S.r("quantile_cont(value, 0.75) - quantile_cont(value, 0.25)", "iqr")
           + ", count(value) AS n_series, count(*) - count(value) AS n_excluded, " + S.r("median(cv)", "cv_p50") + ", "
           + S.r("median(bound_ratio)", "bound_ratio_p50") + " FROM long GROUP BY env, h, model, stratum, metric"))
def stratified_metrics(spark, sf):
    strata = T.assign_strata(each(lambda e: T.burstiness(grid(spark, sf, e))))
    per = each(lambda e: baseline_metrics(spark, sf, e))
    return rounded(M.stratified_report(per, strata, ["env", "h", "model"]))


# ------------------------------------------------------------------ samples and groups


@query(S.q([*S.base()], "SELECT env, series_id, " + S.r("avg(value)", "mean") + ", count(value) AS n_values FROM raw"
           " GROUP BY env, series_id"))
def raw_level(spark, sf):
    return rounded(each(lambda e: machine_means(FLEETS[e](spark, sf))))


_QS = ("lvl AS (SELECT env, series_id, avg(value) AS mean FROM raw GROUP BY env, series_id), "
       "rkd AS (SELECT *, row_number() OVER (ORDER BY mean, series_id) AS rn, count(*) OVER () AS n FROM lvl), "
       "qs AS (SELECT *, greatest(CAST(ceil((rn - 1) * 5 / CAST(n - 1 AS DOUBLE)) AS BIGINT) - 1, 0) AS stratum FROM rkd)")


@query(S.q([*S.base(("C",)), _QS], "SELECT series_id, stratum FROM qs"))
def rank_strata(spark, sf):
    means = machine_means(FLEETS["C"](spark, sf))
    return R.quantile_strata(means, "mean", "series_id").select("series_id", "stratum")


@query(S.q([*S.base(("C",)), _QS], "SELECT series_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum"
           " ORDER BY md5('42|' || series_id), series_id) AS k FROM qs) WHERE k <= 7"))
def frozen_sample(spark, sf):
    means = machine_means(FLEETS["C"](spark, sf))
    strata = R.quantile_strata(means, "mean", "series_id")
    return R.sample_per_stratum(strata, "stratum", "series_id", 7).select("series_id", "stratum")


_ROWS = ("tagged AS (SELECT m.series_id, m.off, stratum FROM mat m JOIN strata s ON m.env = s.env AND m.series_id = s.series_id"
         " WHERE off + h < n_fit), "
         "cnt AS (SELECT stratum, count(*) AS n_rows FROM tagged GROUP BY stratum), "
         "quo AS (SELECT stratum, n_rows, CAST(floor(1000 * n_rows / CAST(sum(n_rows) OVER () AS DOUBLE)) AS BIGINT) AS q,"
         " row_number() OVER (ORDER BY n_rows DESC, stratum) AS big FROM cnt), "
         "quota AS (SELECT stratum, n_rows, CAST(least(n_rows, q + CASE WHEN big = 1 THEN 1000 - (SELECT sum(q) FROM quo)"
         " ELSE 0 END) AS BIGINT) AS quota FROM quo)")


def _tagged(spark, sf):
    from tidemark.operators.splits import fit_rows

    strata = T.assign_strata(T.burstiness(grid(spark, sf, "C"))).select("env", "series_id", "stratum")
    return fit_rows(matrix(spark, sf, "C", horizons=(12,)), SPECS["C"]).join(
        strata, ["env", "series_id"]).select("series_id", "off", "stratum")


@query(S.q([*S.base(("C",)), *S.frame(hs=(12,)), BURST, STRATA, _ROWS], "SELECT stratum, n_rows, quota FROM quota"))
def row_quota(spark, sf):
    return R.row_quotas(_tagged(spark, sf), "stratum", 1000)


@query(S.q([*S.base(("C",)), *S.frame(hs=(12,)), BURST, STRATA, _ROWS],
           "SELECT series_id, off, stratum FROM (SELECT t.*, quota, row_number() OVER (PARTITION BY t.stratum ORDER BY"
           " md5('42|' || series_id || '|' || CAST(off AS VARCHAR)), series_id, off) AS k FROM tagged t JOIN quota USING (stratum))"
           " WHERE k <= quota"))
def proportional_row_sample(spark, sf):
    return R.proportional_rows(_tagged(spark, sf), "stratum", ["series_id", "off"], 1000)


_GROUPS = ("ordr AS (SELECT series_id AS member, row_number() OVER (ORDER BY md5('42|' || series_id), series_id) AS rn,"
           " count(*) OVER () AS n_all FROM ids), "
           "grp AS (SELECT CASE WHEN rn <= n_all // 2 THEN 'Cs' WHEN (rn - n_all // 2 - 1) // 5 < (n_all - n_all // 2) // 5 THEN 'Cg' ELSE 'rest' END AS env,"
           " CASE WHEN rn <= n_all // 2 THEN member WHEN (rn - n_all // 2 - 1) // 5 < (n_all - n_all // 2) // 5"
           " THEN printf('Cg_%02d', (rn - n_all // 2 - 1) // 5) ELSE '' END AS series_id, member FROM ordr)")


def _groups(spark, sf, ids=None):
    """Groups of the supplier fleet; ``ids`` are its series where they are at hand."""
    ids = grid(spark, sf, "C").select("series_id").distinct() if ids is None else ids
    return R.halves_and_groups(ids, "series_id", None, 5, "Cs", "Cg")


@query(S.q([*S.base(("C",)), _GROUPS], "SELECT env, series_id, member FROM grp"))
def single_and_grouped(spark, sf):
    return _groups(spark, sf)


@query(S.q([*S.base(("C",)), _GROUPS],
           "SELECT g.env, g.series_id, f.bucket, f.off, CASE WHEN count(f.y) = max(k) THEN round(avg(f.y), 6) END AS y,"
           " bool_or(f.is_interp) AND count(f.y) = max(k) AS is_interp FROM fleet f JOIN (SELECT *, count(*) OVER"
           " (PARTITION BY env, series_id) AS k FROM grp WHERE env = 'Cg') g ON f.series_id = g.member"
           " GROUP BY g.env, g.series_id, f.bucket, f.off"))
def group_mean_series(spark, sf):
    groups = _groups(spark, sf).where(F.col("env") == "Cg")
    return rounded(R.strict_group_mean(grid(spark, sf, "C"), groups))


@query("SELECT * FROM (VALUES ('group_sizes', CAST(0 AS BIGINT), 'ok'), ('members_disjoint', CAST(0 AS BIGINT), 'ok'))"
       " t(\"check\", n_bad, status) WHERE (SELECT count(*) FROM lineitem) > 0")
def gate_groups(spark, sf):
    return Q.group_gate(_groups(spark, sf), 5)


@query(S.q([*S.base(("C",)), _GROUPS, "part AS (SELECT f.* FROM fleet f JOIN grp ON f.series_id = grp.member WHERE grp.env = 'Cs')"],
           "SELECT c.chk AS \"check\", count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad, 'ok' AS status FROM part,"
           " (VALUES ('row_exists'), ('y'), ('is_interp')) c(chk) GROUP BY c.chk"))
def gate_slice(spark, sf):
    """The single half rebuilt as groups of one equals the matching slice of the fleet."""
    g = grid(spark, sf, "C")
    singles = _groups(spark, sf).where(F.col("env") == "Cs")
    part = R.strict_group_mean(g, singles)
    return Q.slice_gate(part, g, ["series_id", "bucket"], ["y", "is_interp"])


# ------------------------------------------------------------------ autocorrelation

_LAGS = (1, 2, 3, 6, 12, 24)


def _acf_sql(col: str = "y", lags=_LAGS) -> str:
    one = []
    for k in lags:
        both = f"{col} IS NOT NULL AND a{k} IS NOT NULL"
        one.append(
            f"SELECT env, series_id, {k} AS lag, CASE WHEN count(*) FILTER ({both}) >= 30 AND"
            f" var_pop({col}) FILTER ({both}) * count(*) FILTER ({both}) > 1e-12 AND var_pop(a{k}) FILTER ({both})"
            f" * count(*) FILTER ({both}) > 1e-12 THEN corr(a{k}, {col}) END AS acf, count(*) FILTER ({both}) AS n_pairs,"
            f" count(*) FILTER (off >= {k}) AS n_slots FROM lagged GROUP BY env, series_id")
    return ("lagged AS (SELECT *, " + ", ".join(f"lag({col}, {k}) OVER s AS a{k}" for k in lags)
            + " FROM fleet WINDOW s AS (PARTITION BY env, series_id ORDER BY bucket)), acf AS (" + " UNION ALL ".join(one) + ")")


@query(S.q([*S.base(), _acf_sql()], "SELECT env, series_id, lag, " + S.rs("acf") + ", n_pairs, n_slots FROM acf"))
def autocorrelation(spark, sf):
    return rounded(each(lambda e: A.acf(grid(spark, sf, e), list(_LAGS))))


@query(S.q([*S.base(), _acf_sql()], "SELECT env, lag, " + ", ".join(
    S.r(f"quantile_cont(acf, {p / 100})", f"acf_p{p}") for p in (25, 50, 75)) + ", count(acf) AS n_series, "
           + S.r("100 * (1 - sum(n_pairs) / sum(n_slots))", "pairs_lost_pct") + " FROM acf GROUP BY env, lag"))
def autocorrelation_summary(spark, sf):
    return rounded(A.acf_summary(each(lambda e: A.acf(grid(spark, sf, e), list(_LAGS)))))


_PACF = ("wide AS (SELECT env, series_id, max(acf) FILTER (lag = 1) AS r1, max(acf) FILTER (lag = 2) AS r2,"
         " max(acf) FILTER (lag = 3) AS r3 FROM acf GROUP BY env, series_id), "
         "two AS (SELECT *, (r2 - r1 * r1) / (1 - r1 * r1) AS p2, r1 * (1 - r2) / (1 - r1 * r1) AS f21 FROM wide), "
         "three AS (SELECT *, (r3 - f21 * r2 - p2 * r1) / (1 - f21 * r1 - p2 * r2) AS p3 FROM two), "
         "pacf AS (SELECT env, series_id, 1 AS lag, r1 AS pacf FROM three UNION ALL SELECT env, series_id, 2, p2 FROM three"
         " UNION ALL SELECT env, series_id, 3, p3 FROM three)")


@query(S.q([*S.base(), _acf_sql(), _PACF], "SELECT env, series_id, lag, " + S.rs("pacf") + " FROM pacf"))
def partial_autocorrelation(spark, sf):
    return rounded(A.pacf(each(lambda e: A.acf(grid(spark, sf, e), [1, 2, 3])), 3))


@query(S.q([*S.base(), _acf_sql(), _PACF], "SELECT env, lag, " + S.r("median(pacf)", "pacf_p50")
           + ", count(*) AS n_series, CAST(0 AS BIGINT) AS n_dropped FROM pacf GROUP BY env, lag"))
def partial_autocorrelation_summary(spark, sf):
    return rounded(A.pacf_summary(A.pacf(each(lambda e: A.acf(grid(spark, sf, e), [1, 2, 3])), 3), 3))


# Durbin-Levinson, a lag a step: the coefficients so far, the variance left and whether the series is still stable.
_LEVINSON = (
    "rho AS (SELECT env, series_id, list(acf ORDER BY lag) AS rho, count(acf) = 24 AS whole FROM acf GROUP BY env, series_id), "
    "steps AS (SELECT env, series_id, rho, 1 AS lag, [rho[1]] AS phi, 1 - rho[1] * rho[1] AS rest, whole AS alive FROM rho UNION ALL"
    " SELECT env, series_id, rho, lag + 1, list_append(list_transform(phi, lambda x, i: x - p * phi[lag + 1 - i]), p), rest * (1 - p * p), stable FROM"
    " (SELECT *, CASE WHEN stable THEN raw ELSE 0 END AS p FROM (SELECT *, coalesce(abs(raw) < 1, FALSE) AS stable FROM (SELECT *,"
    " CASE WHEN alive AND rest > 1e-10 THEN (rho[lag + 1] - list_sum(list_transform(phi, lambda x, i: x * rho[lag + 1 - i]))) / rest END AS raw"
    " FROM steps WHERE lag < 24))))")


@query(S.q([*S.base(), _acf_sql(lags=range(1, 25)), _LEVINSON],
           "SELECT env, series_id, lag, " + S.r("CASE WHEN alive THEN phi[lag] END", "pacf") + " FROM steps", recursive=True))
def partial_autocorrelation_deep(spark, sf):
    """PACF to lag 24; SQL replays the recursion a lag at a time."""
    return rounded(A.pacf(each(lambda e: A.acf(grid(spark, sf, e), list(range(1, 25)))), 24))


_DESC = ("tr AS (SELECT f.env, f.series_id, f.bucket, f.y, season FROM fleet f JOIN par ON f.env = par.env WHERE off < par.n_train), "
         "dv AS (SELECT *, y - avg(y) OVER (PARTITION BY env, series_id) AS d FROM tr), "
         "dl AS (SELECT a.*, b.d AS d1, c.d AS ds FROM dv a LEFT JOIN dv b ON a.env = b.env AND a.series_id = b.series_id"
         " AND a.bucket = b.bucket + 1 LEFT JOIN dv c ON a.env = c.env AND a.series_id = c.series_id"
         " AND a.bucket = c.bucket + a.season), "
         "dsc AS (SELECT env, series_id, log10(avg(y) + 0.01) AS log_level,"
         " log10(greatest(stddev_samp(y) / greatest(avg(y), 0.001), 0.001)) AS log_cv,"
         " coalesce(sum(d * d1), 0) / nullif(sum(d * d), 0) AS acf_1, coalesce(sum(d * ds), 0) / nullif(sum(d * d), 0) AS acf_season"
         " FROM dl GROUP BY env, series_id)")


@query(S.q([*S.base(), _DESC], "SELECT env, series_id, " + S.rs(*D.DESCRIPTORS) + " FROM dsc"))
def series_descriptors(spark, sf):
    return rounded(each(lambda e: D.descriptors(grid(spark, sf, e), SPECS[e])))


@query()
def descriptor_clusters(spark, sf):
    """k-means on the descriptors of all fleets, applied to grouped series as well."""
    # One row per series of the grid, so that groups are dealt without another scan; groups are averaged once.
    desc = keep(each(lambda e: D.descriptors(grid(spark, sf, e), SPECS[e])))
    groups = _groups(spark, sf, desc.where(F.col("env") == "C").select("series_id"))
    grouped = keep(R.strict_group_mean(grid(spark, sf, "C"), groups.where(F.col("env") == "Cg")))
    assign = K.fit_clusters(desc, starts=3)
    both = assign(desc).unionByName(assign(D.descriptors(grouped, SPECS["C"])))
    return rounded(K.cluster_shares(both))


# ------------------------------------------------------------------ distributions


@query(S.q(S.base(), "SELECT env, count(DISTINCT series_id) AS n_series, count(*) AS n_points, "
           + S.r("avg(y)", "mean") + ", " + S.r("stddev_samp(y)", "std") + ", " + S.r("min(y)", "min") + ", "
           + S.r("max(y)", "max") + ", " + ", ".join(
               S.r(f"quantile_cont(y, {p / 100})", f"p{p}") for p in (10, 25, 50, 75, 90, 95))
           + ", " + S.r("100 * (count(*) - count(y)) / CAST(count(*) AS DOUBLE)", "missing_pct") + ", "
           + S.r("100 * count(*) FILTER (y >= 100) / CAST(count(y) AS DOUBLE)", "ceiling_pct") + ", "
           + S.r("100 * count(*) FILTER (is_interp) / CAST(count(y) AS DOUBLE)", "interp_pct")
           + " FROM fleet GROUP BY env"))
def describe_levels(spark, sf):
    return rounded(D.describe(each(lambda e: grid(spark, sf, e))))


_XS = D.ecdf_grid(linear=101, log=40)


@query(S.q([*S.base(), "xs AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({x!r} AS DOUBLE))" for x in _XS) + ") t(x))",
            "pts AS (SELECT env, y, count(*) AS c FROM fleet WHERE y IS NOT NULL GROUP BY env, y)",
            "tot AS (SELECT env, sum(c) AS n FROM pts GROUP BY env)"],
           "SELECT tot.env, " + S.r("xs.x", "x") + ", " + S.r(
               "coalesce((SELECT sum(c) FROM pts WHERE pts.env = tot.env AND pts.y <= xs.x), 0) / tot.n", "share")
           + " FROM tot, xs"))
def level_ecdf(spark, sf):
    return rounded(D.ecdf(each(lambda e: grid(spark, sf, e)), _XS))


@query(S.q([*S.base(), "bins AS (SELECT env, b.bin FROM (SELECT DISTINCT env FROM fleet), (SELECT unnest(range(50)) AS bin) b)",
            "hit AS (SELECT env, CASE WHEN y = 100 THEN 49 ELSE CAST(floor(y / 2) AS INTEGER) END AS bin, count(*) AS c FROM fleet"
            " WHERE y IS NOT NULL GROUP BY ALL)"],
           "SELECT bins.env, CAST(bins.bin AS INTEGER) AS bin, coalesce(c, 0) AS n_in_bin, " + S.r(
               "100 * coalesce(c, 0) / CAST(sum(coalesce(c, 0)) OVER (PARTITION BY bins.env) AS DOUBLE)", "pct") + ", "
           + S.r("CAST(bins.bin * 2 AS DOUBLE)", "lo") + " FROM bins LEFT JOIN hit ON bins.env = hit.env AND bins.bin = hit.bin"))
def level_histogram(spark, sf):
    return rounded(D.histogram(each(lambda e: grid(spark, sf, e)), 0.0, 100.0, 50))


@query(S.q([*S.base(), BURST,
            "bins AS (SELECT env, b.bin FROM (SELECT DISTINCT env FROM burst), (SELECT unnest(range(39)) AS bin) b)",
            "hit AS (SELECT env, CAST(floor((log10(cv) + 2) / (3.3 / 39)) AS INTEGER) AS bin, count(*) AS c FROM burst"
            " WHERE cv > 0 GROUP BY ALL)"],
           "SELECT bins.env, CAST(bins.bin AS INTEGER) AS bin, coalesce(c, 0) AS n_in_bin, " + S.r(
               "100 * coalesce(c, 0) / CAST(sum(coalesce(c, 0)) OVER (PARTITION BY bins.env) AS DOUBLE)", "pct") + ", "
           + S.r("10.0 ** (-2 + bins.bin * (3.3 / 39))", "lo")
           + " FROM bins LEFT JOIN hit ON bins.env = hit.env AND bins.bin = hit.bin"))
def cv_histogram(spark, sf):
    b = each(lambda e: T.burstiness(grid(spark, sf, e)))
    # SQL divides 0 by 0 where an environment has no value in the bins
    return rounded(D.log_histogram(b, -2.0, 1.3, 39, "cv").withColumn("pct", F.coalesce("pct", F.lit(float("nan")))))


@query(S.q([*PER_TEST, "ratio AS (SELECT a.env, a.h, a.model, a.mae / b.mae AS ratio FROM per a JOIN per b ON a.env = b.env"
            " AND a.h = b.h AND a.series_id = b.series_id AND b.model = 'naive' WHERE a.model <> 'naive' AND b.mae > 0)"],
           "SELECT env, h, model, " + ", ".join(S.r(f"quantile_cont(ratio, {p / 100})", f"p{p}") for p in (5, 25, 50, 75, 95))
           + ", count(*) AS n FROM ratio GROUP BY env, h, model"))
def ratio_box(spark, sf):
    r = D.ratio_to_naive(each(lambda e: baseline_metrics(spark, sf, e)))
    return rounded(D.box_summary(r, ["env", "h", "model"], "ratio"))


PAIRS = [("A", "B"), ("B", "A"), ("A", "C"), ("C", "A"), ("B", "C"), ("C", "B")]


@query(S.q([*S.base(), *S.frame(hs=(1,)),
            "lv AS (SELECT f.env AS source, avg(y) AS level FROM fleet f JOIN par ON f.env = par.env WHERE off < n_train GROUP BY f.env)",
            "cp AS (SELECT source, env AS target, series_id, y_future AS yt, level, y FROM mat JOIN lv ON mat.env <> lv.source"
            " WHERE off >= n_fit AND off + h < n)",
            "cl AS (SELECT source, target, series_id, 'level' AS model, yt, level AS yhat FROM cp UNION ALL"
            " SELECT source, target, series_id, 'naive', yt, y FROM cp)",
            S.metrics("cl", "source, target, model, series_id", "cm", d="1")],
           "SELECT source, target, model, 1 AS h, " + S.r("median(mae)", "mae_p50") + ", count(*) AS n_series FROM cm GROUP BY ALL"))
def constant_level_reference(spark, sf):
    grids = {e: grid(spark, sf, e) for e in S.ALL}
    out = None
    for t in S.ALL:
        for s, _ in [p for p in PAIRS if p[1] == t]:
            c = constant_level(grids[s], matrix(spark, sf, t, horizons=(1,)), SPECS[s].bounds["train"], SPECS[t], [(s, t)])
            out = c if out is None else out.unionByName(c)
    return rounded(M.quantiles(out, ["source", "target", "model", "h"], "mae", {"mae_p50": 0.5}).withColumnRenamed(
        "n", "n_series"))
