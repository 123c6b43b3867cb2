"""Cross-environment experiments: assembly of prediction, result and plan tables."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import FleetSpec
from tidemark.functions.scalar import safe_div
from tidemark.functions.small import pin
from tidemark.operators.metrics import per_series_metrics
from tidemark.operators.normalize import by_mode_to_raw_scale, to_raw_scale
from tidemark.operators.splits import test_rows

RESULT_KEYS = ["source", "target", "mode", "calendar", "h", "model"]


def config_grid(spark: SparkSession, pairs: list[tuple[str, str]], modes: list[str],
                calendars: list[str], horizons: list[int], models: list[str]) -> DataFrame:
    """Every combination to run; built from literal dimension lists."""
    rows = [(s, t, m, c, h, k) for (s, t), m, c, h, k in product(pairs, modes, calendars, horizons, models)]
    return spark.createDataFrame(
        rows, "source string, target string, mode string, calendar string, h int, model string")


def missing_work(grid: DataFrame, done: DataFrame) -> DataFrame:
    """What is left to run, grouped by the source matrix it needs.

    The key goes down to the model: a coarser one would skip models that were never run.
    """
    todo = grid.join(done.select(*RESULT_KEYS).distinct(), RESULT_KEYS, "left_anti")
    return todo.groupBy("source", "mode", "calendar", "h").agg(
        F.sort_array(F.collect_set(F.struct("model", "target"))).alias("work"))


def raw_scale_predictions(scored: DataFrame, mode: str | None = None,
                          pred: str = "prediction") -> DataFrame:
    """``y_true`` and ``yhat`` on the raw scale, by the target series' own parameters.

    Without ``mode`` each row's own ``mode`` column decides.
    """
    args = F.col(pred), F.col("y"), F.col("mu"), F.col("sd")
    yhat = by_mode_to_raw_scale(F.col("mode"), *args) if mode is None else to_raw_scale(mode, *args)
    return scored.withColumns({"y_true": F.col("y_future"), "yhat": yhat})


def level_reference(fit: DataFrame, test: DataFrame, pairs: list[tuple[str, str]] | None = None, runs: bool = False) -> DataFrame:
    """Constant forecast: the source's mean target over its fit rows, scored on every test row.

    It knows nothing but the level, so a transfer result near it says nothing either.
    ``fit`` and ``test`` may hold several environments and modes; what crosses between
    environments is one number per (environment, mode, horizon). With named (source, target)
    ``pairs`` a test row meets only the sources of its own environment, otherwise every source.
    With ``runs`` a column ``run`` of the fit rows tells several runs apart, which share the scan of the test rows.
    """
    run = ["run"] if runs else []
    level = pin(fit.groupBy(F.col("env").alias("source"), *run, "mode", "h").agg(
        F.avg("target").alias("prediction")))
    keys = ["mode", "h"]
    if pairs is not None:
        wanted = fit.sparkSession.createDataFrame(sorted(set(pairs)), "source string, target_env string")
        level, keys = pin(level.join(wanted, "source")), ["target_env", *keys]
    pred = raw_scale_predictions(test.withColumnRenamed("env", "target_env").join(level, keys))
    m = per_series_metrics(pred, [*run, "source", "target_env", "mode", "h", "series_id"])
    return m.withColumnRenamed("target_env", "target").withColumn("model", F.lit("level"))


def constant_level(grid_source: DataFrame, matrix_target: DataFrame, bounds: tuple[int, int],
                   spec_target: FleetSpec, pairs: list[tuple[str, str]]) -> DataFrame:
    """Mean level of the source inside ``bounds`` as forecast on the target, beside the naive one.

    The pair list is a literal and the levels are one number per environment.
    """
    lo, hi = bounds
    level = grid_source.where((F.col("off") >= lo) & (F.col("off") < hi)).groupBy("env").agg(
        F.avg("y").alias("level")).withColumnRenamed("env", "source")
    wanted = grid_source.sparkSession.createDataFrame(pairs, "source string, env string")
    level = pin(wanted.join(pin(level), "source"))
    rows = test_rows(matrix_target, spec_target).join(level, "env")
    long = rows.select(
        "source", F.col("env").alias("target"), "series_id", "h", F.col("y_future").alias("y_true"),
        F.explode(F.array(
            F.struct(F.lit("level").alias("model"), F.col("level").alias("yhat")),
            F.struct(F.lit("naive").alias("model"), F.col("y").alias("yhat")))).alias("p"),
    ).select("source", "target", "series_id", "h", "y_true", "p.*")
    return per_series_metrics(long, ["source", "target", "h", "model", "series_id"])


def replace_rows(base: DataFrame, new: DataFrame, mode: str, horizons: list[int] | None = None) -> DataFrame:
    """Swap in re-run results of one mode; combinations the re-run lacks stay as they were."""
    n = new.where(F.col("mode") == mode)
    if horizons:
        n = n.where(F.col("h").isin(list(horizons)))
    key = ["source", "target", "mode", "h", "model"]
    kept = base.join(n.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(n.select(*[c for c in base.columns if c in n.columns]), allowMissingColumns=True)


def final_table(raw: DataFrame, sensitivity: DataFrame, corrected: DataFrame,
                corrected_horizons: list[int]) -> DataFrame:
    """N0 as first run, N1 from the sensitivity run, N2 from the corrected run."""
    return replace_rows(replace_rows(raw, sensitivity, "N1"), corrected, "N2", corrected_horizons)


def split_by_role(results: DataFrame, main_envs: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Diagonal and transfer rows of the main environments, and the rows of the others."""
    main = F.col("source").isin(main_envs) & F.col("target").isin(main_envs)
    same = F.col("source") == F.col("target")
    return results.where(main & same), results.where(main & ~same), results.where(
        ~F.col("source").isin(main_envs))


def transfer_cost(transfer_agg: DataFrame, own_agg: DataFrame) -> DataFrame:
    """Aggregate MAE median of the transferred model over the target's own model."""
    own = own_agg.where(F.col("metric") == "mae").select(
        F.col("env").alias("target"), "h", "model", F.col("p50").alias("mae_own"))
    t = transfer_agg.where(F.col("metric") == "mae").withColumnRenamed("p50", "mae_transfer")
    return t.join(own, ["target", "h", "model"]).withColumn(
        "cost", safe_div(F.col("mae_transfer"), F.col("mae_own")))


def copy_baselines(grid: DataFrame, baseline_agg: DataFrame) -> DataFrame:
    """Baselines of the target repeated for each combination: they learn nothing from a source."""
    cells = grid.select("source", "target", "mode", "calendar", "h").distinct()
    b = baseline_agg.where(F.col("split") == "test").drop("split").withColumnRenamed("env", "target")
    return cells.join(b, ["target", "h"])
