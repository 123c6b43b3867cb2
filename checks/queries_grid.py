"""Cleaning, grid alignment, gaps, catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.fleets import each, grid, regular, rounded
from checks.registry import query
from tidemark.operators import catalog as C
from tidemark.operators import gaps as P
from tidemark.operators import grid as G
from tidemark.operators.clean import clip_counts, drop_columns, mask_sentinels
from tidemark.plans import quality as Q
from tidemark.sources.tables import FLEETS, SPECS


@query(S.q(S.base(), "SELECT env, series_id, count(*) AS n_rows, CAST(sum(hi) AS BIGINT) AS n_high,"
           " CAST(sum(lo) AS BIGINT) AS n_low FROM clipped GROUP BY env, series_id"))
def clip_count(spark, sf):
    return each(lambda e: clip_counts(FLEETS[e](spark, sf), SPECS[e]))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n_rows, count(d) AS n_discount, "
       + S.r("avg(d)", "avg_discount") + ", " + S.r("avg(l_quantity)", "avg_quantity")
       + " FROM (SELECT *, CASE WHEN l_discount NOT IN (0.0, 0.1) THEN l_discount END AS d FROM lineitem)"
       " GROUP BY l_returnflag, l_linestatus")
def sentinel_mask(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    t = drop_columns(mask_sentinels(t, {"l_discount": [0.0, 0.1], "not_there": [-1]}), ["l_tax", "gone"])
    return rounded(t.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("l_discount").alias("n_discount"),
        F.avg("l_discount").alias("avg_discount"), F.avg("l_quantity").alias("avg_quantity")))


@query(S.q(S.base(), "SELECT env, b0 FROM origin"))
def window_origin(spark, sf):
    def one(e):
        starts = G.origins(FLEETS[e](spark, sf), SPECS[e])
        return spark.createDataFrame(sorted(starts.items()), "env string, b0 long") if isinstance(starts, dict) else starts
    return each(one)


@query(S.q(S.base(), "SELECT env, series_id, bucket, " + S.r("y") + ", n_rows, n_high FROM gridm"))
def bucket_mean(spark, sf):
    return rounded(each(lambda e: G.to_grid(FLEETS[e](spark, sf), SPECS[e]).where(
        F.col("bucket").isNotNull()).select("env", "series_id", "bucket", "y", "n_rows", "n_high")))


@query(S.q(S.base(), "SELECT env, series_id, bucket, off, " + S.rs("y_obs", "y") + ", is_interp FROM fleet"))
def regular_series(spark, sf):
    return rounded(each(lambda e: grid(spark, sf, e).drop("b0")))


@query(S.q(S.base(), "SELECT env, series_id, count(*) AS n_rows, min(bucket) AS first_bucket,"
           " max(bucket) AS last_bucket, CAST(count(*) - (max(bucket) - min(bucket) + 1) AS BIGINT) AS n_breaks"
           " FROM fleet GROUP BY env, series_id"))
def contiguous_grid(spark, sf):
    return each(lambda e: G.grid_breaks(G.assert_contiguous(grid(spark, sf, e))))


_RUNS = ("runs AS (SELECT env, series_id, isl, min(bucket) AS start, max(bucket) + 1 AS stop, count(*) AS length FROM"
         " (SELECT *, bucket - row_number() OVER (PARTITION BY env, series_id ORDER BY bucket) AS isl FROM fleet"
         " WHERE {cond}) GROUP BY env, series_id, isl)")


@query(S.q([*S.base(), _RUNS.format(cond="y_obs IS NULL")],
           "SELECT env, count(*) AS n_gaps, CAST(sum(length) AS BIGINT) AS n_missing, "
           + S.r("quantile_cont(length, 0.5)", "len_p50") + ", " + S.r("quantile_cont(length, 0.9)", "len_p90")
           + ", max(length) AS len_max, " + S.r("avg(CASE WHEN length <= 2 THEN 1.0 ELSE 0.0 END)", "short_share")
           + " FROM runs GROUP BY env"))
def gap_structure(spark, sf):
    return rounded(each(lambda e: P.gap_summary(grid(spark, sf, e), SPECS[e])))


@query(S.q([*S.base(), _RUNS.format(cond="y IS NOT NULL")],
           "SELECT env, series_id, start, stop, length FROM runs WHERE length >= 100"))
def long_segments(spark, sf):
    return each(lambda e: P.segments(grid(spark, sf, e), 100, "y"))


_FILLED = ("ff AS (SELECT *, last_value(y_obs IGNORE NULLS) OVER (PARTITION BY env, series_id ORDER BY bucket"
           " ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ff3 FROM fleet)")
_SHORT = ("sf AS (SELECT a.*, CASE WHEN y_obs IS NOT NULL THEN y_obs"
          " WHEN pb IS NOT NULL AND coalesce(nb, mx + 1) - pb - 1 <= 2 THEN pv END AS ff_short FROM (SELECT *,"
          " max(bucket) OVER (PARTITION BY env, series_id) AS mx FROM anchored) a)")


@query(S.q([*S.base(), _FILLED, _SHORT],
           "SELECT ff.env, ff.series_id, ff.bucket, " + S.rs("ff3", "ff_short")
           + " FROM ff JOIN sf ON ff.env = sf.env AND ff.series_id = sf.series_id AND ff.bucket = sf.bucket"))
def forward_filled(spark, sf):
    def one(e):
        d = P.forward_fill(grid(spark, sf, e), 3, out="ff3")
        d = P.forward_fill(d, 2, out="ff_short", only_gaps_up_to=2)
        return d.select("env", "series_id", "bucket", "ff3", "ff_short")
    return rounded(each(one))


_MASK = "count({c}) OVER (PARTITION BY env, series_id ORDER BY bucket ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) = 25 AND lead({c}, {h}) OVER (PARTITION BY env, series_id ORDER BY bucket) IS NOT NULL"


def _policies_sql() -> str:
    runs = []
    for name, col in (("raw_runs", "y_obs"), ("fill_runs", "y")):
        runs.append(_RUNS.format(cond=f"{col} IS NOT NULL").replace("runs AS", f"{name} AS", 1))
    ctes = [
        *S.base(), _FILLED, *runs,
        "flags AS (SELECT *, " + ", ".join(
            f"{_MASK.format(c=c, h=h)} AS {n}" for c, h, n in
            (("y_obs", 1, "m1"), ("y_obs", 12, "m12"), ("y", 1, "f1"), ("y", 12, "f12"))) + " FROM ff)",
        "per AS (SELECT env, series_id, coalesce(min(CASE WHEN ff3 IS NULL THEN off END), count(*)) AS cut,"
        " count(*) FILTER (m1) AS m1, count(*) FILTER (m12) AS m12, count(*) FILTER (f1) AS f1,"
        " count(*) FILTER (f12) AS f12 FROM flags GROUP BY env, series_id)",
        "pol AS (SELECT env, 'cut_after_ffill' AS policy, sum(CASE WHEN cut > 36 THEN cut - 25 ELSE 0 END) AS r1,"
        " sum(CASE WHEN cut > 36 THEN cut - 36 ELSE 0 END) AS r12, count(*) FILTER (cut > 36) AS u FROM per GROUP BY env"
        " UNION ALL SELECT env, 'row_mask', sum(m1), sum(m12), count(*) FILTER (m12 > 0) FROM per GROUP BY env"
        " UNION ALL SELECT env, 'fill_then_mask', sum(f1), sum(f12), count(*) FILTER (f12 > 0) FROM per GROUP BY env"
        " UNION ALL SELECT e.env, 'segments', coalesce(sum(greatest(length - 25, 0)), 0),"
        " coalesce(sum(greatest(length - 36, 0)), 0), count(length)"
        " FROM origin e LEFT JOIN (SELECT * FROM raw_runs WHERE length >= 72) x ON e.env = x.env GROUP BY e.env"
        " UNION ALL SELECT e.env, 'fill_then_segments', coalesce(sum(greatest(length - 25, 0)), 0),"
        " coalesce(sum(greatest(length - 36, 0)), 0), count(length)"
        " FROM origin e LEFT JOIN (SELECT * FROM fill_runs WHERE length >= 72) x ON e.env = x.env GROUP BY e.env)",
    ]
    return S.q(ctes, "SELECT p.env, p.policy, CAST(p.r1 AS BIGINT) AS rows_short, CAST(p.r12 AS BIGINT) AS rows_long,"
                     " CAST(p.u AS BIGINT) AS units, " + S.r("CAST(p.r12 AS DOUBLE) / greatest(b.r12, 1)", "ratio_to_mask")
               + " FROM pol p JOIN (SELECT env, r12 FROM pol WHERE policy = 'row_mask') b ON p.env = b.env")


@query(_policies_sql())
def gap_policy(spark, sf):
    return rounded(each(lambda e: P.gap_policies(grid(spark, sf, e), SPECS[e], min_segment=72)))


@query(S.q([*S.base(), f"flags AS (SELECT *, {_MASK.format(c='y_obs', h=1)} AS m1 FROM fleet)",
            "anyk AS (SELECT *, bool_or(m1) OVER (PARTITION BY env, series_id) AS anyk FROM flags)"],
           "SELECT env, CASE WHEN m1 THEN 'kept' ELSE 'dropped' END AS side, " + S.r("median(y_obs)", "p50")
           + ", count(*) AS n FROM anyk WHERE anyk AND y_obs IS NOT NULL GROUP BY ALL"))
def mask_selection_bias(spark, sf):
    return rounded(each(lambda e: P.mask_bias(grid(spark, sf, e), SPECS[e])))


def _safety_sql() -> str:
    cols = []
    for name, c in (("obs", "y_obs"), ("fill", "y"), ("ffill", "ff_short")):
        for k in (1, 12):
            cols.append(f"lag({c}, {k}) OVER s AS {name}_{k}")
    rs = []
    for name, c in (("obs", "y_obs"), ("fill", "y"), ("ffill", "ff_short")):
        for k in (1, 12):
            both = f"{c} IS NOT NULL AND {name}_{k} IS NOT NULL"
            rs.append(f"CASE WHEN count(*) FILTER ({both}) >= 30 AND var_pop({c}) FILTER ({both}) > 0"
                      f" AND var_pop({name}_{k}) FILTER ({both}) > 0 THEN corr({name}_{k}, {c}) END AS r_{name}_{k}")
    longs = []
    for k in (1, 12):
        for m, e in (("obs", f"r_obs_{k}"), ("fill", f"r_fill_{k}"), ("ffill", f"r_ffill_{k}"),
                     ("fill_change", f"abs(r_fill_{k} - r_obs_{k})"), ("ffill_change", f"abs(r_ffill_{k} - r_obs_{k})")):
            longs.append(f"SELECT env, {k} AS lag, '{m}' AS measure, {e} AS value FROM ok")
    ctes = [*S.base(), _SHORT,
            "sf2 AS (SELECT sf.*, fleet.y FROM sf JOIN fleet ON sf.env = fleet.env AND sf.series_id = fleet.series_id"
            " AND sf.bucket = fleet.bucket)",
            "sh AS (SELECT *, " + ", ".join(cols) + " FROM sf2 WINDOW s AS (PARTITION BY env, series_id ORDER BY bucket))",
            "rr AS (SELECT env, series_id, " + ", ".join(rs) + " FROM sh GROUP BY env, series_id)",
            "ok AS (SELECT * FROM rr WHERE " + " AND ".join(
                f"r_{n}_{k} IS NOT NULL" for n in ("obs", "fill", "ffill") for k in (1, 12)) + ")",
            "lg AS (" + " UNION ALL ".join(longs) + ")"]
    return S.q(ctes, "SELECT env, lag, measure, " + S.r("median(value)", "p50") + ", "
               + S.r("quantile_cont(value, 0.95)", "p95") + ", count(*) AS n FROM lg GROUP BY env, lag, measure")


@query(_safety_sql())
def fill_safety(spark, sf):
    return rounded(each(lambda e: P.fill_safety(grid(spark, sf, e), SPECS[e])))


def prof_sql(max_gap: int = 2) -> list[str]:
    valid = ", ".join(f"{_MASK.format(c='y', h=h)} AS v{h}" for h in (1, 6, 12))
    return [
        *S.base(max_gap=max_gap),
        f"vr AS (SELECT *, {valid} FROM fleet)",
        "agg0 AS (SELECT env, series_id, count(y) AS n_points, count(*) FILTER (is_interp) AS n_interp,"
        " count(*) FILTER (v1) AS valid_rows_h1, count(*) FILTER (v6) AS valid_rows_h6,"
        " count(*) FILTER (v12) AS valid_rows_h12, avg(y_obs) AS mean, median(y_obs) AS p50,"
        " stddev_samp(y_obs) AS sd, count(y_obs) AS n_obs, avg(y) AS mean_filled, count(DISTINCT y) AS n_distinct"
        " FROM vr GROUP BY env, series_id)",
        "rawc AS (SELECT env, series_id, CAST(sum(hi) AS BIGINT) AS n_clipped, count(*) AS n_raw_rows FROM clipped"
        " GROUP BY env, series_id)",
        "prof AS (SELECT c.env, c.series_id, coalesce(n_points, 0) AS n_points, coalesce(n_interp, 0) AS n_interp,"
        " coalesce(valid_rows_h1, 0) AS valid_rows_h1, coalesce(valid_rows_h6, 0) AS valid_rows_h6,"
        " coalesce(valid_rows_h12, 0) AS valid_rows_h12, mean, p50, CASE WHEN n_obs > 1 THEN sd ELSE 0 END AS std,"
        " n_clipped, n_raw_rows, CASE WHEN coalesce(n_points, 0) = 0 THEN 'out_of_window' WHEN mean_filled < 1 THEN"
        " 'near_dead' WHEN n_distinct < 3 THEN 'constant' WHEN valid_rows_h12 < min_rows THEN 'too_few_rows' ELSE ''"
        " END AS reject_reason FROM rawc c JOIN par ON c.env = par.env LEFT JOIN agg0 a ON c.env = a.env"
        " AND c.series_id = a.series_id)",
    ]


FUNNEL = ("SELECT env, count(*) AS series_in, "
          + ", ".join(f"count(*) FILTER (reject_reason = '{x}') AS out_{x}" for x in C.REASONS)
          + ", count(*) FILTER (reject_reason = '') AS series_kept, "
          + ", ".join(f"CAST(coalesce(sum(valid_rows_h{h}) FILTER (reject_reason = ''), 0) AS BIGINT) AS valid_rows_h{h}"
                      for h in (1, 6, 12))
          + ", 100 * sum(n_interp) FILTER (reject_reason = '') / sum(n_points) FILTER (reject_reason = '') AS interp_pct,"
          " 100.0 * sum(n_clipped) / sum(n_raw_rows) AS clipped_pct,"
          " sum(mean * n_points) FILTER (reject_reason = '') / sum(n_points) FILTER (reject_reason = '') AS target_mean"
          " FROM {src} GROUP BY env")


@query(S.q(prof_sql(), "SELECT env, series_id, reject_reason = '' AS kept, reject_reason, n_points, n_interp,"
           " valid_rows_h1, valid_rows_h6, valid_rows_h12, " + S.rs("mean", "p50", "std") + ", n_clipped,"
           " 'host-1' AS built_on, '2024-01-01T00:00:00' AS built_at FROM prof"))
def series_catalog(spark, sf):
    return rounded(each(lambda e: C.catalog(
        C.profile(regular(spark, sf, e), SPECS[e]), SPECS[e], "host-1", "2024-01-01T00:00:00")))


_NAMES = (["series_in"] + [f"out_{x}" for x in C.REASONS] + ["series_kept"] + [f"valid_rows_h{h}" for h in (1, 6, 12)]
          + ["interp_pct", "clipped_pct", "target_mean"])


@query(S.q([*prof_sql(), "fn AS (" + FUNNEL.format(src="prof") + ")"],
           "SELECT env, " + ", ".join(_NAMES[:-3]) + ", " + S.rs(*_NAMES[-3:]) + " FROM fn"))
def screening_funnel(spark, sf):
    return rounded(each(lambda e: C.funnel(C.profile(regular(spark, sf, e), SPECS[e]), SPECS[e])))


def _sensitivity_sql() -> str:
    one = S.q([*prof_sql(2), "fn AS (" + FUNNEL.format(src="prof") + ")"],
              " UNION ALL ".join(f"SELECT env, '{n}' AS quantity, CAST({n} AS DOUBLE) AS v FROM fn" for n in _NAMES))
    two = S.q([*prof_sql(0), "fn AS (" + FUNNEL.format(src="prof") + ")"],
              " UNION ALL ".join(f"SELECT env, '{n}' AS quantity, CAST({n} AS DOUBLE) AS v FROM fn" for n in _NAMES))
    return ("SELECT a.env, a.quantity, " + S.r("a.v", "filled") + ", " + S.r("b.v", "unfilled")
            + f" FROM ({one}) a JOIN ({two}) b ON a.env = b.env AND a.quantity = b.quantity")


@query(_sensitivity_sql())
def gap_fill_sensitivity(spark, sf):
    return rounded(each(lambda e: C.gap_sensitivity(
        regular(spark, sf, e), regular(spark, sf, e, max_gap=0), SPECS[e])))


@query(S.q(prof_sql(), "SELECT f.env, f.series_id, f.bucket, " + S.r("f.y", "y") + ", f.is_interp FROM fleet f"
           " JOIN prof p ON f.env = p.env AND f.series_id = p.series_id WHERE p.reject_reason = ''"))
def processed_table(spark, sf):
    def one(e):
        reg = regular(spark, sf, e)
        return C.processed(reg, C.profile(reg, SPECS[e])).select("env", "series_id", "bucket", "y", "is_interp")
    return rounded(each(one))


@query(S.q(prof_sql(), "SELECT env, series_id, valid_rows_h1, valid_rows_h6, valid_rows_h12 FROM prof"
           " WHERE n_points > 0"))
def valid_row_count(spark, sf):
    return each(lambda e: C.count_valid_rows(grid(spark, sf, e), SPECS[e]))


@query(S.q(prof_sql(), "SELECT env, c.chk AS \"check\", count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad, 'ok' AS status"
           " FROM prof, (VALUES ('known_reason'), ('kept_iff_no_reason'), ('id_well_formed'),"
           " ('points_not_below_filled')) c(chk) GROUP BY env, c.chk"))
def gate_catalog(spark, sf):
    def one(e):
        cat = C.catalog(C.profile(regular(spark, sf, e), SPECS[e]), SPECS[e])
        return Q.catalog_gate(cat, {"A": "^[a-z]+$", "B": "^[FOP]_[1-5]-", "C": "^s[0-9]+$"})
    return each(one)


@query(S.q(prof_sql(), "SELECT env, series_id, 'only_second' AS side FROM prof WHERE reject_reason <> ''"))
def kept_vs_listed(spark, sf):
    """Processed ids against all listed ids: what is missing are exactly the rejected series."""
    def one(e):
        reg = regular(spark, sf, e)
        prof = C.profile(reg, SPECS[e])
        return Q.set_difference(C.processed(reg, prof), prof, ["env", "series_id"])
    return each(one)


@query(S.q(prof_sql(), "SELECT env, series_id FROM prof WHERE reject_reason = ''"))
def kept_and_listed(spark, sf):
    def one(e):
        reg = regular(spark, sf, e)
        prof = C.profile(reg, SPECS[e])
        return Q.shared_keys(C.processed(reg, prof), prof, ["env", "series_id"])
    return each(one)


@query(S.q(prof_sql(), "SELECT count(DISTINCT CASE WHEN env = 'C' THEN 'host-2' ELSE 'host-1' END) AS n_hosts, count(DISTINCT env) AS n_runs,"
           " 'fail' AS status FROM prof"))
def gate_provenance(spark, sf):
    """Environments built in separate runs, one of them on another host: a failure."""
    cats = each(lambda e: C.catalog(C.profile(regular(spark, sf, e), SPECS[e]), SPECS[e], "host-2" if e == "C" else "host-1", f"run-{e}"))
    return Q.provenance_gate(cats)


@query(S.q([*prof_sql(), "fn AS (" + FUNNEL.format(src="prof") + ")",
            "clip AS (SELECT env, 100.0 * sum(CASE WHEN v2 THEN 1 ELSE 0 END) / count(*) AS c FROM"
            " (SELECT env, hi = 1 AS v2 FROM clipped) GROUP BY env)"],
           "SELECT fn.env, q.quantity, CAST(0.01 AS DOUBLE) AS tolerance, " + S.r("e", "expected") + ", " + S.r("g", "got")
           + ", CAST(0 AS DOUBLE) AS rel_diff, 'ok' AS status FROM fn JOIN clip ON fn.env = clip.env,"
           " LATERAL (VALUES ('clipped_pct', c, clipped_pct), ('series_in',"
           " CAST(series_in AS DOUBLE), CAST(series_in AS DOUBLE))) q(quantity, e, g)"))
def gate_numbers(spark, sf):
    """Funnel numbers against an independent count from the raw rows, within 1 %."""
    def one(e):
        raw = FLEETS[e](spark, sf)
        f = C.funnel(C.profile(regular(spark, sf, e), SPECS[e]), SPECS[e])
        got = f.select("env", F.col("clipped_pct"), F.col("series_in").cast("double").alias("series_in")).unpivot(
            ["env"], ["clipped_pct", "series_in"], "quantity", "value")
        exp = raw.groupBy("env").agg(
            (100 * F.avg((F.col("value") > 100).cast("double"))).alias("clipped_pct"),
            F.count_distinct("series_id").cast("double").alias("series_in")).unpivot(
            ["env"], ["clipped_pct", "series_in"], "quantity", "value").withColumn("tolerance", F.lit(0.01))
        return Q.against_reference(got, exp, ["env", "quantity"])
    return rounded(each(one))


@query(S.q(S.base(), "SELECT env, " + S.r("100.0 * count(*) FILTER (is_interp) / count(y)", "interp_pct")
           + ", CASE WHEN 100.0 * count(*) FILTER (is_interp) / count(y) > 5 THEN 'warn' ELSE 'ok' END AS status"
           " FROM fleet GROUP BY env"))
def gate_interpolation_share(spark, sf):
    return rounded(each(lambda e: Q.interpolation_share(grid(spark, sf, e))))
