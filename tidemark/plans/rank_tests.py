"""Non-parametric tests over series, with Holm correction and verdicts.

Ranks come from ``value_ranks`` and medians from ``quantiles``, which spread a
comparison over many tasks when it has many series.  The signed-rank test of a small
sample without ties or zeros is exact; other p-values use the normal approximation:
Wilcoxon with tie correction, Mann-Whitney also with continuity correction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import is_small, keep, medians, quantiles, value_ranks
from tidemark.functions.scalar import correlation, median_of, safe_div
from tidemark.functions.tails import two_sided_normal, two_sided_signed_rank, two_sided_student

ALPHA = 0.05
# Differences this small count as no difference at all.
ALL_EQUAL = 1e-8
# Ranked values are rounded first: a mean summed in another partition order differs in its
# last bits, and without rounding that noise would break mathematical ties at random.
TIE_DIGITS = 9
# Pairs up to which the signed-rank test uses the exact distribution.
EXACT_PAIRS = 50


def wilcoxon(pairs: DataFrame, keys: list[str], small: bool | None = None) -> DataFrame:
    """Signed-rank test of ``a`` against ``b`` per key; one input row per series.

    ``diff_p50`` is the median of the differences, which alone gives the test its
    direction: the difference of the medians can have the other sign. ``p_from`` names the
    source of the p-value: ``exact`` for at most ``EXACT_PAIRS`` pairs without zero or tied
    differences, ``equal`` (p = 1) if all are zero, else ``normal``.
    """
    d = keep(pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull())
             .withColumn("diff", F.round(F.col("a") - F.col("b"), TIE_DIGITS)))
    if small is None:
        small = is_small(d)
    size = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_series"),
        F.count_if(F.col("diff") < 0).alias("n_a_lower"),
        F.max(F.abs("diff")).alias("_largest"))
    middle = medians(d, keys, ["a", "b", "diff"], small)
    moved = d.where(F.col("diff") != 0).select(*keys, "diff", F.abs("diff").alias("size"))
    ranks = value_ranks(moved, keys, "size", {"n_up": (F.col("diff") > 0).cast("long")}, small=small)
    n = F.col("_n")
    sums = ranks.groupBy(*keys).agg(
        F.sum(F.col("avg_rank") * F.col("n_up")).alias("w_plus"),
        F.max("n_total").alias("_n"),
        F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("_ties"))
    sums = sums.withColumn("w_minus", n * (n + 1) / 2 - F.col("w_plus"))
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    statistic = F.least("w_plus", "w_minus")
    sums = sums.withColumn("statistic", statistic).withColumn(
        "z", safe_div(statistic - n * (n + 1) / 4, F.sqrt(var)))
    same = F.col("_largest") <= ALL_EQUAL
    out = size.join(middle, keys).join(sums.select(*keys, "statistic", "z", "_n", "_ties"), keys, "left")
    exact = (F.col("n_series") <= EXACT_PAIRS) & (F.col("_n") == F.col("n_series")) & (F.col("_ties") == 0)
    return (
        out.withColumn("statistic", F.when(~same, F.col("statistic")))
        .withColumn("z", F.when(~same, F.col("z")))
        .withColumn("p_from", F.when(same, "equal").when(exact, "exact").otherwise("normal"))
        .withColumn("p", F.when(F.col("p_from") == "equal", F.lit(1.0))
                    .when(F.col("p_from") == "exact", two_sided_signed_rank(F.col("n_series"), F.col("statistic")))
                    .otherwise(two_sided_normal("z")))
        .drop("_largest", "_n", "_ties")
    )


def mann_whitney(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Rank-sum test of ``side`` 'a' against 'b' per key, with the rank-biserial effect.

    A positive effect means that side 'a' tends to the larger values.  Keys where one
    side is empty have no test and no row.
    """
    s = keep(samples.where(F.col("value").isNotNull())
             .withColumn("value", F.round("value", TIE_DIGITS)))
    small = is_small(s)
    middle = quantiles(s, [*keys, "side"], "value", {"p50": 0.5}, small=small)
    middle = middle.groupBy(*keys).pivot("side", ["a", "b"]).agg(
        F.first("p50").alias("p50"), F.first("n").alias("n"))
    ranks = value_ranks(s, keys, "value", {"n_a": (F.col("side") == "a").cast("long")}, small=small)
    sums = ranks.groupBy(*keys).agg(
        F.sum(F.col("avg_rank") * F.col("n_a")).alias("_r"),
        F.sum("n_a").alias("_na"), F.max("n_total").alias("_n"),
        F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("_ties"))
    na, n = F.col("_na"), F.col("_n")
    nb = n - na
    sums = sums.where((na > 0) & (nb > 0)).withColumn("u_a", F.col("_r") - na * (na + 1) / 2)
    larger = F.greatest(F.col("u_a"), na * nb - F.col("u_a"))
    var = na * nb / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1)))
    z = safe_div(larger - na * nb / 2 - 0.5, F.sqrt(var))
    sums = sums.select(
        *keys, "u_a", (2 * F.col("u_a") / (na * nb) - 1).alias("rank_biserial"), z.alias("z"))
    out = middle.join(sums, keys)
    return out.withColumn(
        # The continuity correction can push z below 0, where the p-value is capped at 1.
        "p", F.when(F.col("z") > 0, two_sided_normal("z")).otherwise(F.lit(1.0)))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation per key and its p-value by the t approximation."""
    rows = keep(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.round(x, TIE_DIGITS).alias(x), F.round(y, TIE_DIGITS).alias(y)))
    small = is_small(rows)
    rx = value_ranks(rows.select(*keys, x), keys, x, small=small).select(*keys, x, F.col("avg_rank").alias("_rx"))
    ry = value_ranks(rows.select(*keys, y), keys, y, small=small).select(*keys, y, F.col("avg_rank").alias("_ry"))
    ranked = rows.join(rx, [*keys, x]).join(ry, [*keys, y])
    r = ranked.groupBy(*keys).agg(correlation(F.col("_rx"), F.col("_ry")).alias("rho"), F.count(F.lit(1)).alias("n_series"))
    dof = F.col("n_series") - 2
    t = F.col("rho") * F.sqrt(safe_div(dof.cast("double"), 1 - F.col("rho") * F.col("rho")))
    # A perfect correlation has an infinite t, whose tail is 0.
    perfect = (F.abs("rho") >= 1) & (dof >= 1)
    return r.withColumn("p", F.when(perfect, 0.0).otherwise(two_sided_student(t, dof.cast("double"))))


def holm(df: DataFrame, family: list[str], p: str = "p", out: str = "p_holm") -> DataFrame:
    """Holm-Bonferroni within each family of tests (one row per test, so a family is small)."""
    part = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(1))
    ordered = part.orderBy(F.col(p).asc_nulls_last())
    up_to = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = (F.count(p).over(part) - F.row_number().over(ordered) + 1) * F.col(p)
    return df.withColumn("_step", step).withColumn(
        out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("_step").over(up_to)))).drop("_step")


def verdict(df: DataFrame, effect: str, negative: str, positive: str,
            alpha: float = ALPHA) -> DataFrame:
    """Label each test by significance and by the sign of its effect."""
    sig = F.coalesce(F.col("p_holm") < alpha, F.lit(False))
    label = (
        F.when(~sig, "no_difference").when(F.col(effect) < 0, negative)
        .when(F.col(effect) > 0, positive).otherwise("significant_zero_median")
    )
    return df.withColumn("significant", sig).withColumn("verdict", label)


# ---------------------------------------------------------------- within an environment


def model_pairs(per_series: DataFrame, models: list[str], metric: str = "mae") -> DataFrame:
    """Every pair of models on the series both were scored on.

    A series has one row per model, so the models of a series are gathered with one
    aggregation and paired in place instead of by a self-join.
    """
    cols = {m: F.max(F.when(F.col("model") == m, F.col(metric))).alias(f"_m{i}")
            for i, m in enumerate(models)}
    wide = per_series.groupBy("env", "h", "series_id").agg(*cols.values())
    pairs = [
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                 F.col(f"_m{i}").alias("a"), F.col(f"_m{j}").alias("b"))
        for i, a in enumerate(models) for j, b in enumerate(models) if i < j]
    return wide.select("env", "h", "series_id", F.explode(F.array(*pairs)).alias("p")).select(
        "env", "h", "series_id", "p.*").where(F.col("a").isNotNull() & F.col("b").isNotNull())


def compare_models(per_series: DataFrame, models: list[str], min_series: int = 10,
                   alpha: float = ALPHA) -> DataFrame:
    """Signed-rank test of all model pairs within (env, h), Holm within (env, h)."""
    keys = ["env", "h", "model_a", "model_b"]
    t = wilcoxon(model_pairs(per_series, models), keys).where(F.col("n_series") >= min_series)
    t = t.withColumn("delta_of_medians", F.col("a_p50") - F.col("b_p50"))
    t = holm(t, ["env", "h"])
    sig = F.coalesce(F.col("p_holm") < alpha, F.lit(False))
    return t.withColumn("significant", sig).withColumn(
        "better", F.when(~sig, "inconclusive").when(F.col("diff_p50") < 0, F.col("model_a"))
        .otherwise(F.col("model_b")))


def models_vs_reference(tests: DataFrame, per_series: DataFrame, reference: str = "naive") -> DataFrame:
    """One row per (env, h, model): ratio to the reference, median paired difference, wins."""
    ref_is_a = F.col("model_a") == reference
    t = tests.where(ref_is_a | (F.col("model_b") == reference)).select(
        "env", "h", F.when(ref_is_a, F.col("model_b")).otherwise(F.col("model_a")).alias("model"),
        F.when(ref_is_a, -F.col("diff_p50")).otherwise(F.col("diff_p50")).alias("diff_p50"),
        "p_holm", "significant")
    med = quantiles(per_series, ["env", "h", "model"], "mae", {"mae_p50": 0.5}).drop("n")
    ref = med.where(F.col("model") == reference).select(
        "env", "h", F.col("mae_p50").alias("mae_p50_reference"))
    k = ["env", "h", "series_id"]
    base = per_series.where(F.col("model") == reference).select(*k, F.col("mae").alias("_ref"))
    wins = per_series.where(F.col("model") != reference).join(base, k).groupBy("env", "h", "model").agg(
        F.count_if(F.col("mae") < F.col("_ref")).alias("n_better"), F.count(F.lit(1)).alias("n_series"))
    return (
        t.join(med, ["env", "h", "model"]).join(ref, ["env", "h"]).join(wins, ["env", "h", "model"])
        .withColumn("ratio", safe_div(F.col("mae_p50"), F.col("mae_p50_reference")))
        .withColumn("beats_reference", (F.col("diff_p50") < 0) & F.col("significant"))
    )


# ---------------------------------------------------------------- between environments

TRANSFER_KEYS = ["source", "target", "mode", "h", "model"]


def transfer_vs_naive(transfer: DataFrame, naive: DataFrame) -> DataFrame:
    """Transferred model against the naive forecast of the target; Holm per (source, target, h)."""
    n = naive.select(F.col("env").alias("target"), "h", "series_id", F.col("mae").alias("b"))
    x = transfer.join(n, ["target", "h", "series_id"]).withColumn("a", F.col("mae"))
    t = wilcoxon(x.select(*TRANSFER_KEYS, "a", "b"), TRANSFER_KEYS)
    t = t.withColumn("ratio_p50", safe_div(F.col("a_p50"), F.col("b_p50")))
    return verdict(holm(t, ["source", "target", "h"]), "diff_p50", "better_than_naive", "worse_than_naive")


def _mode_columns(per_series: DataFrame, keys: list[str]) -> DataFrame:
    return per_series.groupBy(*keys, "series_id").pivot("mode", ["N0", "N1", "N2"]).agg(F.avg("mae"))


def modes_vs_raw(per_series: DataFrame, keys: list[str], family: list[str]) -> DataFrame:
    """N1 and N2 against N0 on the same series."""
    wide = _mode_columns(per_series, keys)
    pairs = wide.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(f"{m}_vs_N0").alias("comparison"), F.col(m).alias("a"), F.col("N0").alias("b"))
        for m in ("N1", "N2")])).alias("p")).select(*keys, "p.*")
    t = holm(wilcoxon(pairs, [*keys, "comparison"]), family)
    return verdict(t, "diff_p50", "better_than_N0", "worse_than_N0")


def n2_vs_n1(per_series: DataFrame, keys: list[str], family: list[str]) -> DataFrame:
    wide = _mode_columns(per_series, keys).withColumn("a", F.col("N2")).withColumn("b", F.col("N1"))
    t = holm(wilcoxon(wide.select(*keys, "a", "b"), keys), family)
    return verdict(t, "diff_p50", "N2_better", "N1_better")


def loss_table(transfer: DataFrame, diagonal: DataFrame) -> DataFrame:
    """Transfer loss ``L``: MAE of source to target over the target's own model, same mode.

    A zero or missing denominator leaves ``L`` NULL but keeps the pair for paired tests.
    """
    d = diagonal.select("target", "mode", "h", "model", "series_id", F.col("mae").alias("mae_diagonal"))
    x = transfer.where(F.col("source") != F.col("target")).join(
        d, ["target", "mode", "h", "model", "series_id"])
    return x.withColumn(
        "loss", F.when(F.col("mae_diagonal") > 0, F.col("mae") / F.col("mae_diagonal")))


def transfer_vs_diagonal(loss: DataFrame) -> DataFrame:
    """Does transfer cost anything; Holm per (source, target, h), with the median loss."""
    loss = keep(loss)
    small = is_small(loss)
    x = loss.select(*TRANSFER_KEYS, F.col("mae").alias("a"), F.col("mae_diagonal").alias("b"))
    t = wilcoxon(x, TRANSFER_KEYS, small)
    med = medians(loss, TRANSFER_KEYS, ["loss"], small)
    t = holm(t.join(med, TRANSFER_KEYS), ["source", "target", "h"])
    return verdict(t, "diff_p50", "transfer_better", "transfer_worse")


def median_loss(loss: DataFrame) -> DataFrame:
    """The median losses of :func:`transfer_vs_diagonal` for the same pairs, without its tests."""
    return medians(loss.where(F.col("mae").isNotNull() & F.col("mae_diagonal").isNotNull()), TRANSFER_KEYS, ["loss"])


def asymmetry(df: DataFrame, value: str, directions: list[tuple[tuple[str, str], tuple[str, str]]],
              ) -> DataFrame:
    """Forward against reverse direction of each pair of environments; Holm over the whole table."""
    def which(pair: tuple[str, str]) -> Column:
        return (F.col("source") == pair[0]) & (F.col("target") == pair[1])

    tags = [F.struct(F.lit(f"{f[0]}->{f[1]}").alias("forward"), F.lit(f"{r[0]}->{r[1]}").alias("reverse"),
                     F.when(which(f), "a").when(which(r), "b").alias("side"), F.col(value).alias("value"))
            for f, r in directions]
    keys = ["forward", "reverse", "mode", "h", "model"]
    samples = df.withColumn("_t", F.explode(F.array(*tags))).select(
        "mode", "h", "model", "_t.*").where(F.col("side").isNotNull())
    t = holm(mann_whitney(samples.select(*keys, "side", "value"), keys), [])
    t = verdict(t, "rank_biserial", "reverse_costs_more", "forward_costs_more")
    return t.withColumn("agrees_with_medians",
                        F.signum("rank_biserial") == F.signum(F.col("a_p50") - F.col("b_p50")))


def verdict_counts(tests: DataFrame, keys: list[str]) -> DataFrame:
    return tests.groupBy(*keys, "verdict").agg(F.count(F.lit(1)).alias("n_tests"))


def verdict_crosstab(tests: DataFrame, keys: list[str], verdicts: list[str]) -> DataFrame:
    return tests.groupBy(*keys).pivot("verdict", verdicts).agg(F.count(F.lit(1))).fillna(0, verdicts)


def loss_medians(tests: DataFrame) -> DataFrame:
    """Median of the per-test median losses, modes as columns: one small row set per pair."""
    return tests.groupBy("source", "target").pivot("mode", ["N0", "N1", "N2"]).agg(median_of("loss_p50"))
