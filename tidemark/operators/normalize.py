"""Three normalisation modes of a series and their inverse.

N0 keeps the raw scale.  N1 is a z-score with the series' own train-range mean and
sample deviation.  N2 is the first difference, whose forecast target is
``y[t+h] - y[t]``: differencing first and shifting afterwards would predict one
step instead of h.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import FleetSpec
from tidemark.functions.scalar import SERIES, finite, safe_div, series_window, whole_series

MODES = ("N0", "N1", "N2")


def check_mode(mode: str) -> str:
    m = str(mode).strip().upper()
    if m not in MODES:
        raise ValueError(f"unknown normalisation mode {mode!r}, expected one of {MODES}")
    return m


def _in_train(spec: FleetSpec) -> Column:
    lo, hi = spec.bounds["train"]
    return (F.col("off") >= lo) & (F.col("off") < hi)


def _stats(spec: FleetSpec) -> dict[str, Column]:
    y = F.when(_in_train(spec), F.col("y"))
    return {"mu": F.avg(y), "sd": F.stddev_samp(y), "n_train": F.count(y)}


def train_stats(df: DataFrame, spec: FleetSpec) -> DataFrame:
    """Per series: train mean, deviation, points and whether a z-score exists."""
    s = df.groupBy(*SERIES).agg(*[c.alias(n) for n, c in _stats(spec).items()])
    enough = F.col("n_train") >= 2
    return s.select(
        *SERIES, F.when(enough, F.col("mu")).alias("mu"), F.when(enough, F.col("sd")).alias("sd"),
        "n_train", F.coalesce(enough & (F.col("sd") > 0), F.lit(False)).alias("usable"))


def normalisation_table(df: DataFrame, spec: FleetSpec) -> DataFrame:
    """One row per (mode, series); only N1 has parameters, the others stay NULL."""
    s = train_stats(df, spec)
    return s.select(*SERIES, "mu", "sd", "n_train", F.explode(
        F.array(*[F.lit(m) for m in MODES])).alias("mode")).select(
        "env", "mode", "series_id",
        F.when(F.col("mode") == "N1", F.col("mu")).alias("mu"),
        F.when(F.col("mode") == "N1", F.col("sd")).alias("sd"),
        F.col("n_train").alias("n_rows_train"))


def with_train_stats(df: DataFrame, spec: FleetSpec) -> DataFrame:
    """Carry ``mu`` and ``sd`` on every row.

    Taken over the series window, whose partitioning the features use anyway, so it
    needs neither a second scan nor a join.
    """
    w = whole_series()
    s = {n: c.over(w) for n, c in _stats(spec).items()}
    d = df.withColumns({"_mu": s["mu"], "_sd": s["sd"], "_n": s["n_train"]})
    enough = F.col("_n") >= 2
    return d.withColumn("mu", F.when(enough, F.col("_mu"))).withColumn(
        "sd", F.when(enough, F.col("_sd"))).drop("_mu", "_sd", "_n")


def zscore() -> Column:
    """NULL where the deviation is zero or undefined: no epsilon, no substitute."""
    return safe_div(F.col("y") - F.col("mu"), F.col("sd"))


def transform(df: DataFrame, spec: FleetSpec, mode: str, out: str = "z") -> DataFrame:
    """Add the series in the scale of ``mode``; N1 also carries ``mu`` and ``sd``."""
    mode = check_mode(mode)
    if mode == "N0":
        return df.withColumn(out, F.col("y"))
    if mode == "N1":
        return with_train_stats(df, spec).withColumn(out, zscore())
    return df.withColumn(out, F.col("y") - F.lag("y", 1).over(series_window()))


def to_raw_scale(mode: str, pred: Column, y: Column | None = None, mu: Column | None = None,
                 sd: Column | None = None) -> Column:
    """Map a forecast back with the parameters of the series it is made for."""
    mode = check_mode(mode)
    if mode == "N0":
        return pred
    if mode == "N1":
        return F.when(sd != 0, pred * sd + mu)
    return y + pred


def by_mode_to_raw_scale(mode: Column, pred: Column, y: Column, mu: Column, sd: Column) -> Column:
    """The same for rows of several modes."""
    return F.coalesce(*[F.when(mode == m, to_raw_scale(m, pred, y, mu, sd)) for m in MODES])


INVARIANT_LIMITS = {"naive_n0_n1": 1e-9, "ma6_n0_n1": 1e-9, "naive_n0_n2": 0.0}


def invariants(df: DataFrame, spec: FleetSpec) -> DataFrame:
    """Largest round-trip error per environment of three forecasts that no mode may change.

    The moving average here ends at ``t``; the forecast baseline of the same name
    ends at ``t - 1``.
    """
    w = series_window()
    wide = with_train_stats(df, spec).withColumn("z", zscore())
    last6 = w.rowsBetween(-5, 0)

    def mean6(c: str) -> Column:
        return F.when(F.count(c).over(last6) == 6, F.avg(c).over(last6))

    wide = wide.withColumn("_my", mean6("y")).withColumn("_mz", mean6("z"))

    def back(c: str) -> Column:
        return to_raw_scale("N1", F.col(c), mu=F.col("mu"), sd=F.col("sd"))

    errors = {
        "naive_n0_n1": F.abs(F.col("y") - back("z")),
        "ma6_n0_n1": F.abs(F.col("_my") - back("_mz")),
        "naive_n0_n2": F.abs(to_raw_scale("N2", F.lit(0.0), y=F.col("y")) - F.col("y")),
    }
    worst = wide.groupBy("env").agg(*[
        F.coalesce(F.max(e), F.lit(0.0)).alias(n) for n, e in errors.items()])
    return worst.select("env", F.explode(F.array(*[
        F.struct(F.lit(n).alias("invariant"), F.col(n).alias("max_error"),
                 F.lit(INVARIANT_LIMITS[n]).alias("limit"),
                 (F.col(n) <= INVARIANT_LIMITS[n]).alias("holds"))
        for n in errors])).alias("i")).select("env", "i.*")


def samuelson_screen(df: DataFrame, spec: FleetSpec) -> DataFrame:
    """Series whose z-score leaves what is possible inside a sample of their train size.

    Within n points no |z| can exceed (n - 1)/sqrt(n).  A larger |z| in the fit range
    shows that the train range does not describe the series; such a series is
    excluded from training.  ``n_violations`` counts breaches inside train, which
    the bound rules out, and must be 0.
    """
    lo, hi = spec.fit_bounds
    d = with_train_stats(df, spec).withColumn("_z", F.abs(zscore()))
    s = d.groupBy(*SERIES).agg(
        F.count(F.when(_in_train(spec), F.col("y"))).alias("n_train"),
        F.max("mu").alias("mu"), F.max("sd").alias("sd"),
        F.max(F.when((F.col("off") >= lo) & (F.col("off") < hi), finite(F.col("_z")))).alias("max_abs_z"),
        F.max(F.when(_in_train(spec), finite(F.col("_z")))).alias("_z_train"),
    ).withColumn("bound", (F.col("n_train") - 1) / F.sqrt(F.col("n_train")))
    usable = F.coalesce(F.col("sd") > 0, F.lit(False))
    slack = 1 + 1e-12
    return s.select(
        *SERIES, "n_train", "mu", "sd", "max_abs_z", "bound",
        F.coalesce(usable & (F.col("max_abs_z") > F.col("bound")), F.lit(False)).alias("excluded"),
        F.coalesce(usable & (F.col("_z_train") > F.col("bound") * slack), F.lit(False)).cast("int")
        .alias("n_violations"))


def without_excluded(fit: DataFrame, screen: DataFrame) -> DataFrame:
    """Drop screened series from a training set; scoring sets keep every series."""
    return fit.join(screen.where("excluded").select(*SERIES), SERIES, "left_anti")
