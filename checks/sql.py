"""Building blocks of the oracle SQL: the same chain written as plain relational CTEs.

The formulation is deliberately another one than the operators use: a generated
calendar joined to the bucket means, and running first/last values for the gaps.
"""

from __future__ import annotations

from tidemark.sources.tables import SPECS

ALL = ("A", "B", "C")
HS = (1, 6, 12)

_RAW = {
    "A": "SELECT 'A' AS env, event_type AS series_id, CAST(floor(epoch(ts)) AS BIGINT) AS time_s,"
         " CAST(value AS DOUBLE) AS value FROM events",
    "B": "SELECT 'B' AS env, o_orderstatus || '_' || o_orderpriority AS series_id,"
         " CAST(floor(epoch(o_orderdate)) AS BIGINT) AS time_s,"
         " sqrt(CAST(o_totalprice AS DOUBLE)) / 7 AS value FROM orders",
    "C": "SELECT 'C' AS env, 's' || CAST(l_suppkey AS VARCHAR) AS series_id,"
         " CAST(floor(epoch(l_shipdate)) AS BIGINT) AS time_s,"
         " CAST(l_quantity AS DOUBLE) AS value FROM lineitem",
}

FEATURES = (
    [f"lag_{k}" for k in (1, 2, 3, 6, 12, 24)]
    + [f"roll_{s}_{w}" for w in (6, 12) for s in ("mean", "std", "min", "max")]
    + ["diff_1", "hour_sin", "hour_cos", "dow_sin", "dow_cos"]
)


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """A rounded double without negative zero."""
    x = f"round({expr}, {digits})"
    return f"CASE WHEN {x} = 0 THEN CAST(0 AS DOUBLE) ELSE {x} END AS {name or expr}"


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(r(n, digits=digits) for n in names)


def params(envs) -> str:
    rows = []
    for e in envs:
        s = SPECS[e]
        b = s.bounds
        rows.append(f"('{e}', {s.grid_s}, {s.n_buckets}, {s.season}, {b['train'][1]}, {b['val'][1]},"
                    f" {s.min_valid_rows})")
    return ("par AS (SELECT * FROM (VALUES " + ", ".join(rows)
            + ") t(env, grid_s, n, season, n_train, n_fit, min_rows))")


def base(envs=ALL, max_gap: int = 2) -> list[str]:
    """raw -> clipped -> gridm (bucket means) -> obs (full grid) -> fleet (gaps filled)."""
    raw = " UNION ALL ".join(_RAW[e] for e in envs)
    return [
        params(envs),
        f"raw AS ({raw})",
        "clipped AS (SELECT raw.env, series_id, time_s, CAST(floor(CAST(time_s AS DOUBLE) / grid_s) AS BIGINT)"
        " AS bucket, CASE WHEN value > 100 THEN 100 WHEN value < 0 THEN 0 ELSE value END AS v,"
        " CASE WHEN value > 100 THEN 1 ELSE 0 END AS hi, CASE WHEN value < 0 THEN 1 ELSE 0 END AS lo, n"
        " FROM raw JOIN par ON raw.env = par.env)",
        "origin AS (SELECT env, min(bucket) AS b0 FROM clipped GROUP BY env)",
        "gridm AS (SELECT c.env, c.series_id, c.bucket, avg(v) AS y, count(*) AS n_rows,"
        " CAST(sum(hi) AS BIGINT) AS n_high FROM clipped c JOIN origin o ON c.env = o.env"
        " WHERE c.bucket >= b0 AND c.bucket < b0 + n GROUP BY c.env, c.series_id, c.bucket)",
        "ids AS (SELECT DISTINCT env, series_id FROM gridm)",
        "cal AS (SELECT ids.env, series_id, b0, unnest(range(n)) AS off FROM ids"
        " JOIN origin ON ids.env = origin.env JOIN par ON ids.env = par.env)",
        "obs AS (SELECT cal.env, cal.series_id, b0, b0 + off AS bucket, off, gridm.y AS y_obs FROM cal"
        " LEFT JOIN gridm ON cal.env = gridm.env AND cal.series_id = gridm.series_id"
        " AND gridm.bucket = b0 + off)",
        "anchored AS (SELECT *, last_value(y_obs IGNORE NULLS) OVER p AS pv,"
        " last_value(CASE WHEN y_obs IS NOT NULL THEN bucket END IGNORE NULLS) OVER p AS pb,"
        " first_value(y_obs IGNORE NULLS) OVER f AS nv,"
        " first_value(CASE WHEN y_obs IS NOT NULL THEN bucket END IGNORE NULLS) OVER f AS nb FROM obs"
        " WINDOW p AS (PARTITION BY env, series_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
        " f AS (PARTITION BY env, series_id ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
        "fleet AS (SELECT env, series_id, b0, bucket, off, y_obs, CASE WHEN y_obs IS NOT NULL THEN y_obs"
        f" WHEN nb - pb - 1 <= {max_gap} THEN pv + (nv - pv) * (CAST(bucket - pb AS DOUBLE) / (nb - pb)) END AS y,"
        f" y_obs IS NULL AND coalesce(nb - pb - 1 <= {max_gap}, FALSE) AS is_interp FROM anchored)",
    ]


def stats() -> str:
    """Train-range mean and deviation per series (``norm``)."""
    return ("norm AS (SELECT f.env, series_id, CASE WHEN count(y) >= 2 THEN avg(y) END AS mu,"
            " CASE WHEN count(y) >= 2 THEN stddev_samp(y) END AS sd, count(y) AS n_train"
            " FROM fleet f JOIN par ON f.env = par.env WHERE off < n_train GROUP BY f.env, series_id)")


def scale() -> str:
    """MASE denominator per series (``scl``)."""
    return ("stepped AS (SELECT f.env, f.series_id, f.off, p.n_train, abs(y - lag(y, 1) OVER"
            " (PARTITION BY f.env, series_id ORDER BY bucket)) AS s FROM fleet f JOIN par p ON f.env = p.env),"
            " scl AS (SELECT env, series_id, avg(s) AS d FROM stepped WHERE off > 0 AND off < n_train"
            " GROUP BY env, series_id)")


def frame(mode: str = "N0", name: str = "mat", hs=HS, valid_only: bool = True) -> list[str]:
    """Feature rows of one mode; needs ``fleet`` and ``par``, and ``norm`` for N1."""
    z = {"N0": "f.y", "N1": "(f.y - mu) / nullif(sd, 0)",
         "N2": "f.y - lag(f.y, 1) OVER (PARTITION BY f.env, f.series_id ORDER BY f.bucket)"}[mode]
    join = (" LEFT JOIN norm ON f.env = norm.env AND f.series_id = norm.series_id" if mode == "N1" else "")
    extra = "norm.mu, norm.sd" if mode == "N1" else "CAST(NULL AS DOUBLE) AS mu, CAST(NULL AS DOUBLE) AS sd"
    t = {"N0": "lead(y, {h}) OVER s", "N1": "lead(z, {h}) OVER s", "N2": "lead(y, {h}) OVER s - y"}[mode]
    rolls = []
    for w in (6, 12):
        for s, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            rolls.append(f"CASE WHEN count(z) OVER w{w} = {w} THEN {fn}(z) OVER w{w} END AS roll_{s}_{w}")
    out = [
        f"{name}_z AS (SELECT f.env, f.series_id, f.b0, f.bucket, f.off, f.y, {extra}, {z} AS z, p.grid_s, p.season,"
        f" p.n_train, p.n_fit, p.n FROM fleet f JOIN par p ON f.env = p.env{join})",
        f"{name}_w AS (SELECT *, "
        + ", ".join(f"lag(z, {k}) OVER s AS lag_{k}" for k in (1, 2, 3, 6, 12, 24)) + ", "
        + ", ".join(rolls)
        + ", z - lag(z, 1) OVER s AS diff_1,"
        " sin(2 * pi() * (CAST(floor(bucket * grid_s / 3600.0) AS BIGINT) % 24) / 24) AS hour_sin,"
        " cos(2 * pi() * (CAST(floor(bucket * grid_s / 3600.0) AS BIGINT) % 24) / 24) AS hour_cos,"
        " sin(2 * pi() * ((CAST(floor(bucket * grid_s / 86400.0) AS BIGINT) + 4) % 7) / 7) AS dow_sin,"
        " cos(2 * pi() * ((CAST(floor(bucket * grid_s / 86400.0) AS BIGINT) + 4) % 7) / 7) AS dow_cos,"
        " count(z) OVER (PARTITION BY env, series_id ORDER BY bucket ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS n25, "
        + ", ".join(f"{t.format(h=h)} AS t{h}, lead(y, {h}) OVER s AS f{h}" for h in hs)
        + f" FROM {name}_z WINDOW s AS (PARTITION BY env, series_id ORDER BY bucket),"
        " w6 AS (PARTITION BY env, series_id ORDER BY bucket ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),"
        " w12 AS (PARTITION BY env, series_id ORDER BY bucket ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))",
        f"{name}_h AS (" + " UNION ALL ".join(
            f"SELECT *, {h} AS h, t{h} AS target, f{h} AS y_future FROM {name}_w" for h in hs) + ")",
        f"{name} AS (SELECT * FROM {name}_h" + (" WHERE n25 = 25 AND target IS NOT NULL)" if valid_only else ")"),
    ]
    return out


SPLIT = ("CASE WHEN off + h < n_train THEN 'train' WHEN off >= n_train AND off + h < n_fit THEN 'val'"
         " WHEN off >= n_fit AND off + h < n THEN 'test' ELSE 'purged' END")


def season_values() -> str:
    """Key lookup one season back (``seas``)."""
    return ("seas AS (SELECT f.env, f.series_id, f.bucket + season AS bucket, f.y AS y_season"
            " FROM fleet f JOIN par ON f.env = par.env)")


def baseline_preds() -> list[str]:
    """``pred``: env, h, model, split, series_id, y, yhat, d over all splits; needs ``mat``."""
    return [
        season_values(), scale(),
        f"mats AS (SELECT m.*, {SPLIT} AS split, seas.y_season, scl.d FROM mat m LEFT JOIN seas ON m.env = seas.env"
        " AND m.series_id = seas.series_id AND m.bucket = seas.bucket LEFT JOIN scl ON m.env = scl.env"
        " AND m.series_id = scl.series_id)",
        "pred AS (SELECT env, h, 'naive' AS model, split, series_id, off, target AS yt, lag_1 + diff_1 AS yhat, d FROM mats"
        " UNION ALL SELECT env, h, 'ma6', split, series_id, off, target, roll_mean_6, d FROM mats"
        " UNION ALL SELECT env, h, 'seasonal', split, series_id, off, target, y_season, d FROM mats)",
    ]


def metrics(src: str, keys: str, name: str = "per", where: str = "TRUE", d: str = "max(d)") -> str:
    """The five metrics per key from columns ``yt, yhat`` (and ``d``)."""
    return (
        f"{name} AS (SELECT {keys}, count(*) AS n_rows, avg(abs(yt - yhat)) AS mae,"
        " sqrt(avg((yt - yhat) * (yt - yhat))) AS rmse,"
        " 100 * avg(CASE WHEN abs(yt) + abs(yhat) = 0 THEN 0 ELSE abs(yt - yhat) / ((abs(yt) + abs(yhat)) / 2) END) AS smape,"
        f" avg(abs(yt - yhat)) / nullif({d}, 0) AS mase,"
        " CASE WHEN min(yt) <> max(yt) THEN 1 - sum((yt - yhat) * (yt - yhat)) / (var_pop(yt) * count(*)) END AS r2"
        f" FROM {src} WHERE yt IS NOT NULL AND yhat IS NOT NULL AND {where} GROUP BY {keys})")


def unpivot(src: str, keys: str, name: str = "long") -> str:
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT {keys}, '{m}' AS metric, {m} AS value FROM {src}" for m in ("mae", "rmse", "smape", "mase", "r2")) + ")"


def aggregate(keys: str, src: str = "long", name: str = "agg") -> str:
    """Quartiles over series with the series count of the environment; needs ``fleet``."""
    return (
        "tot AS (SELECT env, count(DISTINCT series_id) AS n_total FROM fleet GROUP BY env), "
        f"{name} AS (SELECT {keys}, metric, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,"
        " quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,"
        f" count(value) AS n_series, max(n_total) - count(value) AS n_excluded FROM {src} JOIN tot USING (env)"
        f" GROUP BY {keys}, metric)")


def tail(z: str) -> str:
    """Two-sided normal tail by the all-positive series of erf; beyond 6.5 it rounds to 0."""
    x = f"(abs({z}) / sqrt(2.0))"
    series = (f"list_sum(list_transform(range(0, 150), lambda i: exp((2 * i + 1) * ln({x}) - lgamma(i + 1.5)"
              f" - {x} * {x})))")
    return f"CASE WHEN {z} = 0 THEN 1.0 WHEN abs({z}) > 6.5 THEN 0.0 ELSE 1 - {series} END"


def holm(src: str, family: str, name: str) -> str:
    """Adds p_holm; ``family`` may be empty."""
    part = f"PARTITION BY {family}" if family else ""
    return (
        f"{name}_s AS (SELECT *, (count(p) OVER ({part}) - row_number() OVER ({part} ORDER BY p) + 1) * p AS step,"
        f" row_number() OVER ({part} ORDER BY p) AS rn FROM {src}), "
        f"{name} AS (SELECT *, least(1.0, max(step) OVER ({part} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING"
        f" AND CURRENT ROW)) AS p_holm FROM {name}_s)")


def signed_rank(n: str, statistic: str) -> str:
    """Exact two-sided signed-rank tail: sign patterns counted by rank sum, one rank joining at a time."""
    counts = (f"list_reduce(list_concat([[1.0::DOUBLE]], list_transform(range(1, {n} + 1), lambda k: [k::DOUBLE])),"
              " lambda f, k: list_transform(range(0, len(f) + k[1]::BIGINT), lambda s: coalesce(f[s + 1], 0)"
              " + CASE WHEN s >= k[1] THEN f[s + 1 - k[1]::BIGINT] ELSE 0 END))")
    return f"least(1.0, 2 * list_sum(list_slice({counts}, 1, floor({statistic})::BIGINT + 1)) / pow(2.0, {n}))"


def wilcoxon(src: str, keys: str, name: str) -> str:
    """Signed-rank test of a against b from one row per series."""
    using = keys
    return (
        f"{name}_d AS (SELECT {keys}, a, b, round(a - b, 9) AS diff FROM {src} WHERE a IS NOT NULL AND b IS NOT NULL), "
        f"{name}_r AS (SELECT {keys}, diff, rank() OVER (PARTITION BY {keys} ORDER BY abs(diff))"
        f" + (count(*) OVER (PARTITION BY {keys}, abs(diff)) - 1) / 2.0 AS rk,"
        f" count(*) OVER (PARTITION BY {keys}, abs(diff)) AS ties FROM {name}_d WHERE diff <> 0), "
        f"{name}_w AS (SELECT {keys}, count(*) AS n, sum(CASE WHEN diff > 0 THEN rk ELSE 0 END) AS wp,"
        f" sum(CASE WHEN diff < 0 THEN rk ELSE 0 END) AS wm, sum(ties * ties - 1.0) AS tie FROM {name}_r GROUP BY {keys}), "
        f"{name}_g AS (SELECT {keys}, count(*) AS n_series, count(*) FILTER (diff < 0) AS n_a_lower,"
        " max(abs(diff)) AS largest, median(a) AS a_p50, median(b) AS b_p50, median(diff) AS diff_p50"
        f" FROM {name}_d GROUP BY {keys}), "
        f"{name}_z AS (SELECT g.*, n <= 50 AND n = n_series AND tie = 0 AS exact,"
        " CASE WHEN largest > 1e-8 THEN least(wp, wm) END AS statistic,"
        " CASE WHEN largest > 1e-8 THEN (least(wp, wm) - n * (n + 1) / 4.0)"
        " / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tie / 48.0) END AS z"
        f" FROM {name}_g g LEFT JOIN {name}_w w USING ({using})), "
        f"{name} AS (SELECT *, CASE WHEN largest <= 1e-8 THEN 1.0 WHEN exact THEN"
        f" {signed_rank('CASE WHEN exact THEN n_series ELSE 0 END', 'statistic')} ELSE {tail('z')} END AS p,"
        " CASE WHEN largest <= 1e-8 THEN 'equal' WHEN exact THEN 'exact' ELSE 'normal' END AS p_from"
        f" FROM {name}_z)")


def mann_whitney(src: str, keys: str, name: str) -> str:
    """Rank-sum test of side a against b."""
    return (
        f"{name}_v AS (SELECT {keys}, side, round(value, 9) AS value FROM {src}), "
        f"{name}_r AS (SELECT {keys}, side, value, rank() OVER (PARTITION BY {keys} ORDER BY value)"
        f" + (count(*) OVER (PARTITION BY {keys}, value) - 1) / 2.0 AS rk,"
        f" count(*) OVER (PARTITION BY {keys}, value) AS ties FROM {name}_v WHERE value IS NOT NULL), "
        f"{name}_g AS (SELECT {keys}, count(*) FILTER (side = 'a') AS a_n, count(*) FILTER (side = 'b') AS b_n,"
        " median(value) FILTER (side = 'a') AS a_p50, median(value) FILTER (side = 'b') AS b_p50,"
        " sum(rk) FILTER (side = 'a') AS ra, sum(ties * ties - 1.0) AS tie, count(*) AS n"
        f" FROM {name}_r GROUP BY {keys}), "
        f"{name}_u AS (SELECT *, ra - a_n * (a_n + 1) / 2.0 AS u_a FROM {name}_g WHERE a_n > 0 AND b_n > 0), "
        f"{name}_z AS (SELECT *, 2 * u_a / (a_n * b_n) - 1 AS rank_biserial,"
        " (greatest(u_a, a_n * b_n - u_a) - a_n * b_n / 2.0 - 0.5)"
        " / sqrt(a_n * b_n / 12.0 * ((n + 1) - tie / (n * (n - 1.0)))) AS z"
        f" FROM {name}_u), "
        f"{name} AS (SELECT *, CASE WHEN z > 0 THEN {tail('z')} ELSE 1.0 END AS p FROM {name}_z)")


def verdict(effect: str, negative: str, positive: str) -> str:
    return (f"CASE WHEN NOT coalesce(p_holm < 0.05, FALSE) THEN 'no_difference' WHEN {effect} < 0 THEN '{negative}'"
            f" WHEN {effect} > 0 THEN '{positive}' ELSE 'significant_zero_median' END AS verdict")


def regression(src: str, keys: list[str], name: str, alpha: str = "0", features=tuple(FEATURES)) -> list[str]:
    """Ridge of ``target`` on standardised features per key: ``{name}(keys, mt, m, s, w)`` with means, deviations and coefficients.

    The normal equations are solved by elimination, a table per step; a feature that depends on earlier ones gets 0.
    ``alpha`` is an expression over the keys.
    """
    p, k = len(features), ", ".join(keys)
    on = " AND ".join(f"r.{c} = {name}_m.{c}" for c in keys)
    z = [f"CASE WHEN s[{i + 1}] > 1e-9 * greatest(1, abs(m[{i + 1}])) THEN (r.{f} - m[{i + 1}]) / s[{i + 1}] ELSE 0 END AS z{i}" for i, f in enumerate(features)]
    entry = [f"avg(z{i} * z{j}) AS g{i}_{j}" for i in range(p) for j in range(i, p)] + [f"avg(z{i} * zt) AS g{i}_{p}" for i in range(p)]
    cell = lambda i, j: f"g{min(i, j)}_{max(i, j)}" + (f" + ({alpha}) / n" if i == j else "")
    rows = "[" + ", ".join("[" + ", ".join(cell(i, j) for j in range(p + 1)) + "]" for i in range(p)) + "]"
    out = [f"{name}_m AS MATERIALIZED (SELECT {k}, count(*) AS n, avg(target) AS mt, [" + ", ".join(f"avg({f})" for f in features) + "] AS m, ["
           + ", ".join(f"stddev_pop({f})" for f in features) + f"] AS s FROM {src} GROUP BY {k})",
           f"{name}_g AS MATERIALIZED (SELECT {k}, " + ", ".join(entry) + f" FROM (SELECT {', '.join('r.' + c for c in keys)}, r.target - mt AS zt, "
           + ", ".join(z) + f" FROM {src} r JOIN {name}_m ON {on}) GROUP BY {k})",
           f"{name}_0 AS MATERIALIZED (SELECT {k}, {rows} AS g FROM {name}_g JOIN {name}_m USING ({k}))"]
    for i in range(1, p + 1):
        out.append(f"{name}_{i} AS MATERIALIZED (SELECT {k}, CASE WHEN abs(g[{i}][{i}]) < 1e-10 THEN list_transform(g, lambda r, nr: CASE WHEN nr = {i}"
                   f" THEN list_transform(r, lambda x: 0.0::DOUBLE) ELSE r END) ELSE list_transform(g, lambda r, nr: CASE WHEN nr = {i}"
                   f" THEN list_transform(r, lambda x: x / g[{i}][{i}]) ELSE list_transform(r, lambda x, nc: x - r[{i}] / g[{i}][{i}] * g[{i}][nc]) END) END AS g"
                   f" FROM {name}_{i - 1})")
    out.append(f"{name} AS MATERIALIZED (SELECT {k}, mt, m, s, list_transform(g, lambda r: r[{p + 1}]) AS w FROM {name}_{p} JOIN {name}_m USING ({k}))")
    return out


def forecast(row: str, name: str, features=tuple(FEATURES)) -> str:
    """Forecast of a row by the coefficients of ``regression``."""
    return f"({name}.mt" + "".join(
        f" + CASE WHEN {name}.s[{i + 1}] > 1e-9 * greatest(1, abs({name}.m[{i + 1}])) THEN {name}.w[{i + 1}] * ({row}.{f} - {name}.m[{i + 1}]) / {name}.s[{i + 1}]"
        " ELSE 0 END" for i, f in enumerate(features)) + ")"


def student(t: str, dof: str) -> str:
    """Two-sided tail of Student's t: Simpson's rule over the angle atan(t / sqrt(dof)), a share of the whole integral."""
    def part(start: str) -> str:
        return (f"((pi() / 2 - {start}) * list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4"
                f" ELSE 2 END) * pow(cos({start} + (pi() / 2 - {start}) * i / 4000.0), {dof} - 1))))")

    return f"CASE WHEN {dof} >= 1 AND {t} IS NOT NULL THEN {part(f'atan(abs({t}) / sqrt({dof}))')} / {part('0.0')} END"


def q(ctes: list[str], select: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + select
