"""Data-quality gates.  Each returns rows of what was checked, how many rows broke it, and a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import FleetSpec
from tidemark.functions.ordered import settle
from tidemark.functions.scalar import SERIES, safe_div, series_window
from tidemark.operators.catalog import REASONS
from tidemark.operators.features import CALENDAR, calendar_features, feature_names

EPS = 1e-9
OK, FAIL, WARN = "ok", "fail", "warn"


def _status(bad: Column, otherwise: str = FAIL) -> Column:
    return F.when(bad, otherwise).otherwise(OK)


def violations(df: DataFrame, rules: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Count the rows that break each rule, all rules in one pass; NULL counts as broken."""
    by = by or []
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"_{i}") for i, ok in enumerate(rules.values())])
    return counts.select(*by, "n_rows", F.explode(F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(f"_{i}").alias("n_bad"))
        for i, name in enumerate(rules)])).alias("c")).select(
        *by, "c.check", "n_rows", "c.n_bad", _status(F.col("c.n_bad") > 0).alias("status"))


def schema_gate(df: DataFrame, required: list[str], exact: bool = False) -> DataFrame:
    """Column names against the contract; needs no data."""
    missing = [c for c in required if c not in df.columns]
    extra = [c for c in df.columns if c not in required] if exact else []
    return df.sparkSession.createDataFrame(
        [("missing_columns", len(missing), ",".join(missing), OK if not missing else FAIL),
         ("extra_columns", len(extra), ",".join(extra), OK if not extra else FAIL)],
        "check string, n_bad int, detail string, status string")


def catalog_gate(cat: DataFrame, id_patterns: dict[str, str] | None = None) -> DataFrame:
    """Reasons known, kept if and only if there is no reason, ids well formed; per environment."""
    pattern = F.lit(".*")
    for env, p in (id_patterns or {}).items():
        pattern = F.when(F.col("env") == env, F.lit(p)).otherwise(pattern)
    return violations(cat, {
        "known_reason": F.col("reject_reason").isin("", *REASONS),
        "kept_iff_no_reason": F.col("kept") == (F.col("reject_reason") == ""),
        "id_well_formed": F.regexp(F.col("series_id"), pattern),
        "points_not_below_filled": F.col("n_points") >= F.col("n_interp"),
    }, ["env"])


def duplicate_ids(cat: DataFrame) -> DataFrame:
    """Ids used more than once in the whole catalog."""
    return cat.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def missing_environments(cat: DataFrame, wanted: list[str]) -> DataFrame:
    w = cat.sparkSession.createDataFrame([(e,) for e in wanted], "env string")
    return w.join(cat.select("env").distinct(), "env", "left_anti")


def set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of two tables compared both ways."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    only_a = left.exceptAll(right).withColumn("side", F.lit("only_first"))
    only_b = right.exceptAll(left).withColumn("side", F.lit("only_second"))
    return only_a.unionByName(only_b)


def shared_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def provenance_gate(cat: DataFrame) -> DataFrame:
    """One host and one run for the whole catalog."""
    p = cat.agg(F.count_distinct("built_on").alias("n_hosts"), F.count_distinct("built_at").alias("n_runs"))
    return p.withColumn("status", F.when(F.col("n_hosts") > 1, FAIL).when(F.col("n_runs") > 1, WARN).otherwise(OK))


def against_reference(got: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Relative difference of each ``value`` to the expected one, within its ``tolerance``.

    Both tables are ``keys, value``; a quantity missing on either side is a warning.
    """
    x = expected.withColumnRenamed("value", "expected").join(
        got.select(*keys, F.col("value").alias("got")), keys, "full_outer")
    rel = F.abs(F.col("got") - F.col("expected")) / F.greatest(F.abs("expected"), F.lit(1e-12))
    x = x.withColumn("rel_diff", F.when(F.col("got") == F.col("expected"), F.lit(0.0)).otherwise(rel))
    return x.withColumn("status", F.when(F.col("rel_diff").isNull(), WARN).otherwise(
        _status(F.col("rel_diff") > F.coalesce("tolerance", F.lit(0.0)))))


def interpolation_share(processed: DataFrame, limit_pct: float = 5.0) -> DataFrame:
    share = 100 * F.count_if("is_interp") / F.greatest(F.count("y"), F.lit(1))
    return processed.groupBy("env").agg(share.alias("interp_pct")).withColumn(
        "status", _status(F.col("interp_pct") > limit_pct, WARN))


def null_counts(matrix: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    return violations(matrix, {c: F.col(c).isNotNull() for c in cols}, by)


def first_valid_rows(matrix: DataFrame, spec: FleetSpec) -> DataFrame:
    """No series starts before its history is complete."""
    first = matrix.groupBy(*SERIES, "h").agg(F.min("off").alias("first_off"))
    return first.withColumn("status", _status(F.col("first_off") < spec.max_lag))


def rolling_gate(matrix: DataFrame, by: list[str]) -> DataFrame:
    """What must hold if the rolling windows cover exactly the buckets before ``t``."""
    c = F.col
    return violations(matrix, {
        "lag_1_inside_roll_6": (c("roll_min_6") <= c("lag_1") + EPS) & (c("lag_1") <= c("roll_max_6") + EPS),
        "mean_6_inside_range": (c("roll_min_6") <= c("roll_mean_6") + EPS)
        & (c("roll_mean_6") <= c("roll_max_6") + EPS),
        "width_12_contains_6": (c("roll_min_12") <= c("roll_min_6") + EPS)
        & (c("roll_max_12") >= c("roll_max_6") - EPS),
        "deviation_not_negative": (c("roll_std_6") >= 0) & (c("roll_std_12") >= 0),
    }, by)


def shift_gate(matrix: DataFrame, by: list[str], limit: float = 0.999) -> DataFrame:
    """Share of rows whose current value lies in the past range: all of them means the
    window wrongly contains ``t``."""
    y = F.col("lag_1") + F.col("diff_1")
    inside = (F.col("roll_min_6") - EPS <= y) & (y <= F.col("roll_max_6") + EPS)
    return matrix.groupBy(*by).agg(F.avg(inside.cast("double")).alias("share_inside")).withColumn(
        "status", _status(F.col("share_inside") > limit))


def calendar_gate(matrix: DataFrame, spec: FleetSpec, by: list[str], tol: float = 1e-12) -> DataFrame:
    """Calendar columns recomputed from the bucket."""
    again = calendar_features(spec)
    return violations(matrix, {n: F.abs(F.col(n) - again[n]) <= tol for n in CALENDAR}, by)


def calendar_across_modes(a: DataFrame, b: DataFrame, tol: float = 1e-12) -> DataFrame:
    """Calendar columns must not depend on the normalisation mode."""
    k = ["env", "series_id", "bucket", "h"]
    other = b.select(*k, *[F.col(c).alias(f"_{c}") for c in CALENDAR])
    both = a.select(*k, *CALENDAR).join(other, k)
    return violations(both, {c: F.abs(F.col(c) - F.col(f"_{c}")) <= tol for c in CALENDAR}, ["env"])


def feature_fingerprint(matrix: DataFrame, spec: FleetSpec, by: list[str]) -> DataFrame:
    """Mean and deviation of every feature and of the target, one scan."""
    cols = [*feature_names(spec), "target"]
    wide = matrix.groupBy(*by).agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols])
    return wide.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std"))
        for c in cols])).alias("f")).select(*by, "f.*")


def metric_identities(per_series: DataFrame, by: list[str]) -> DataFrame:
    c = F.col
    return violations(per_series, {
        "rmse_not_below_mae": c("rmse") >= c("mae") - EPS,
        "smape_in_0_200": c("smape").between(-EPS, 200 + EPS),
        "r2_at_most_1": c("r2").isNull() | (c("r2") <= 1 + EPS),
        "mase_not_negative": c("mase").isNull() | (c("mase") >= 0),
    }, by)


def aggregate_identities(agg: DataFrame, by: list[str]) -> DataFrame:
    c = F.col
    return violations(agg, {
        "quartiles_ordered": c("p25").isNull() | ((c("p25") <= c("p50")) & (c("p50") <= c("p75"))),
        "iqr_is_difference": c("p25").isNull() | (F.abs(c("iqr") - (c("p75") - c("p25"))) <= EPS),
        "counts_not_negative": (c("n_series") >= 0) & (c("n_excluded") >= 0),
    }, by)


def constant_total(agg: DataFrame, key: str) -> DataFrame:
    """``n_series + n_excluded`` is one number per environment."""
    t = agg.groupBy(key).agg(F.count_distinct(F.col("n_series") + F.col("n_excluded")).alias("n_totals"))
    return t.withColumn("status", _status(F.col("n_totals") != 1))


def purge_gate(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Some rows straddle a boundary, and at most h per series at each of the two inner ones."""
    p = counts.where(F.col("split") == "purged").join(totals, "env")
    ok = F.col("n_rows").between(1, 2 * F.col("h") * F.col("n_total"))
    return p.select("env", "h", "n_rows", "n_total", _status(~ok).alias("status"))


def mode_counts(modes: dict[str, DataFrame]) -> DataFrame:
    """Rows per (env, h) by mode, N1 and N2 as difference to N0."""
    stacked = None
    for m in modes.values():
        c = m.groupBy("env", "h", "mode").agg(F.count(F.lit(1)).alias("n"))
        stacked = c if stacked is None else stacked.unionByName(c)
    wide = stacked.groupBy("env", "h").pivot("mode", list(modes)).agg(F.first("n"))
    return wide.withColumn("n1_equals_n0", F.col("N1") == F.col("N0")).withColumn(
        "n2_lost", F.col("N0") - F.col("N2"))


def n2_row_law(grid: DataFrame, matrix: DataFrame, spec: FleetSpec) -> DataFrame:
    """The N2 matrix has one row where y is clean on ``[t - max_lag - 1, t]`` and at ``t + h``."""
    w = series_window()
    clean = F.count("y").over(w.rowsBetween(-spec.max_lag - 1, 0)) == spec.max_lag + 2
    d = grid.withColumn("_c", clean).withColumns({f"_f{h}": F.lead("y", h).over(w) for h in spec.horizons})
    law = d.groupBy("env").agg(*[
        F.count_if(F.col("_c") & F.col(f"_f{h}").isNotNull()).alias(f"_n{h}") for h in spec.horizons])
    law = law.select("env", F.explode(F.array(*[
        F.struct(F.lit(h).alias("h"), F.col(f"_n{h}").alias("n_law")) for h in spec.horizons])).alias("l")
    ).select("env", "l.*")
    got = matrix.groupBy("env", "h").agg(F.count(F.lit(1)).alias("n_matrix"))
    return law.join(got, ["env", "h"], "left").withColumn(
        "status", _status(F.coalesce(F.col("n_law") != F.col("n_matrix"), F.lit(True))))


def n2_target_gate(matrix: DataFrame, by: list[str]) -> DataFrame:
    """The N2 target is exactly the h-step change of the raw series."""
    return violations(matrix, {
        "target_is_h_step_change": F.col("target") == F.col("y_future") - F.col("y")}, by)


def recovered_parameters(raw_matrix: DataFrame, z_matrix: DataFrame, table: DataFrame,
                         tol: float = 1e-9) -> DataFrame:
    """mu and sd solved back from the two matrices, against the published table.

    y = sd * z + mu is affine, so a regression of y on z recovers both; statistics
    taken over a wrong window cannot survive this.
    """
    k = ["env", "series_id", "bucket", "h"]
    both = raw_matrix.select(*k, F.col("lag_1").alias("_y")).join(
        z_matrix.select(*k, F.col("lag_1").alias("_z")), k)
    slope = safe_div(F.covar_pop("_y", "_z"), F.var_pop("_z"))
    fit = both.groupBy(*SERIES).agg(
        slope.alias("sd_back"), (F.avg("_y") - slope * F.avg("_z")).alias("mu_back"),
        F.count(F.lit(1)).alias("n"), F.max("_z").alias("_hi"), F.min("_z").alias("_lo"))
    x = fit.where((F.col("n") >= 2) & (F.col("_hi") > F.col("_lo"))).join(
        table.where(F.col("mode") == "N1"), SERIES, "left")

    def off(a: str, b: str) -> Column:
        return F.abs(F.col(a) - F.col(b)) > tol * F.greatest(F.lit(1.0), F.abs(b))

    bad = F.coalesce(off("sd_back", "sd") | off("mu_back", "mu"), F.lit(True))
    return x.groupBy("env").agg(
        F.count(F.lit(1)).alias("n_series"), F.count_if(bad).alias("n_bad")).withColumn(
        "status", _status(F.col("n_bad") > 0))


def normalised_recheck(grid: DataFrame, z_matrix: DataFrame, stats: DataFrame, spec: FleetSpec,
                       tol: float = 1e-9) -> DataFrame:
    """N1 matrix rebuilt by key lookups instead of windows: lag, value, target, no bridged gap.

    A series' values are one row, in the order of their buckets, so all lookups of a matrix row take one join by series.
    """
    cells = F.array_sort(F.collect_list(F.struct("bucket", "y")))
    first, last = F.col("_v")[0]["bucket"], F.element_at("_v", -1)["bucket"]
    dense = last - first + 1 == F.size("_v")
    values = grid.groupBy(*SERIES).agg(cells.alias("_v")).select(
        *SERIES, first.alias("_b0"), F.when(dense, F.col("_v")["y"]).alias("_y"), F.when(~dense, F.col("_v")).alias("_v"))
    used = list(dict.fromkeys(["lag_1", "diff_1", f"lag_{spec.max_lag}", "target"]))
    m = z_matrix.select(*SERIES, "h", "bucket", *used)
    # Each made on its own, so that a task sorts one copy of the grid and not three.
    stats = settle(stats.select(*SERIES, F.col("mu").alias("_mu"), F.col("sd").alias("_sd")))
    m = m.join(stats, SERIES).join(settle(values), SERIES, "left")

    def look(shift: int | Column) -> Column:
        """The series' value ``shift`` buckets after the row's: by its place, or by a search where buckets are left out."""
        bucket = F.col("bucket") + shift
        return F.when(F.col("_v").isNull(), F.get("_y", (bucket - F.col("_b0")).cast("int"))).otherwise(
            F.get(F.filter("_v", lambda v: v["bucket"] == bucket), F.lit(0))["y"])

    m = m.select("env", "h", *used, "_mu", "_sd", look(-1).alias("_p1"), look(0).alias("_p0"), look(-spec.max_lag).alias("_pl"), look(F.col("h")).alias("_pf"))

    def z(c: str) -> Column:
        return safe_div(F.col(c) - F.col("_mu"), F.col("_sd"))

    def near(a: Column, b: Column) -> Column:
        return F.abs(a - b) <= tol * F.greatest(F.lit(1.0), F.abs(b))

    return violations(m, {
        "lag_1": near(F.col("lag_1"), z("_p1")),
        "value_at_t": near(F.col("lag_1") + F.col("diff_1"), z("_p0")),
        "deepest_lag": near(F.col(f"lag_{spec.max_lag}"), z("_pl")),
        "target": near(F.col("target"), z("_pf")),
        "target_present_in_raw": F.col("_pf").isNotNull(),
    }, ["env", "h"])


def group_gate(groups: DataFrame, group_size: int) -> DataFrame:
    """Every member once, groups of the same size, no member both single and grouped."""
    sizes = groups.where(F.col("env") != "rest").groupBy("env", "series_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("member").alias("k"))
    ok = (F.col("n") == F.col("k")) & ((F.col("n") == 1) | (F.col("n") == group_size))
    bad_sizes = sizes.agg(F.count_if(~ok).alias("n_bad")).select(F.lit("group_sizes").alias("check"), "n_bad")
    twice = groups.groupBy("member").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("n_bad")).select(F.lit("members_disjoint").alias("check"), "n_bad")
    return bad_sizes.unionByName(twice).withColumn("status", _status(F.col("n_bad") > 0))


def slice_gate(part: DataFrame, whole: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """``part`` equals the rows of ``whole`` with the same keys, column by column, NULLs included."""
    other = whole.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_here"))
    x = part.select(*keys, *cols).join(other, keys, "left")
    rules = {"row_exists": F.col("_here")}
    rules.update({c: F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols})
    return violations(x, rules)


def completeness(results: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Result keys against the planned keys, both ways and for repetition."""
    have = results.select(*keys)
    missing = wanted.select(*keys).distinct().join(have.distinct(), keys, "left_anti").count()
    extra = have.distinct().join(wanted.select(*keys).distinct(), keys, "left_anti").count()
    twice = have.groupBy(*keys).count().where(F.col("count") > 1).count()
    return results.sparkSession.createDataFrame(
        [(n, v, OK if v == 0 else FAIL) for n, v in
         (("missing", missing), ("extra", extra), ("repeated", twice))],
        "check string, n_bad long, status string")


def reproduction(again: DataFrame, first: DataFrame, keys: list[str], value: str = "mae",
                 limit: float = 1e-9) -> DataFrame:
    """A repeated run against the first one: largest relative change, unmatched rows on each side."""
    a = again.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = first.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    x = a.join(b, keys, "full_outer")
    rel = F.abs(F.col("_a") - F.col("_b")) / F.greatest(F.abs("_b"), F.lit(1e-12))
    return x.agg(
        F.count_if(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()).alias("n_both"),
        F.count_if(F.col("_in_b").isNull()).alias("n_only_again"),
        F.count_if(F.col("_in_a").isNull()).alias("n_only_first"),
        F.max(rel).alias("max_rel_change")).withColumn(
        "status", _status((F.col("n_only_again") > 0) | (F.col("n_only_first") > 0)
                          | (F.coalesce("max_rel_change", F.lit(0.0)) > limit)))


def claims(claimed: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rounded claims ``item, claim, digits`` against recomputed ``item, value``."""
    x = claimed.join(recomputed, "item", "left")
    v = _round_to("value", "digits")
    same = F.abs(v - F.col("claim")) <= 1e-9
    return x.withColumn("rounded", v).withColumn(
        "status", F.when(F.col("value").isNull(), "missing").when(same, OK).otherwise("differs"))


def _round_to(value: str, digits: str) -> Column:
    scale = F.pow(F.lit(10.0), F.col(digits))
    return F.rint(F.col(value) * scale) / scale
