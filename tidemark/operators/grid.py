"""From raw measurements to complete series on a fixed time grid.

Physical plan: one partially aggregated exchange on (env, series, bucket) and one
exchange on (env, series).  Everything downstream that works per series reuses
the second partitioning.  There is no join of a generated calendar: a series is
completed by letting every measured bucket emit the empty buckets up to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import FleetSpec
from tidemark.functions.scalar import bucket_of, series_window
from tidemark.functions.small import pin
from tidemark.operators.clean import clip_values


# Up to this many environments their origins are folded into the plan as literals.
MAX_LITERAL_ENVS = 64


def origins(raw: DataFrame, spec: FleetSpec) -> dict[str, int] | DataFrame:
    """First bucket ``b0`` per environment, over all rows, missing values included.

    Reads two columns and keeps one row per environment and task before the shuffle.
    A few environments come back as a dict, more as a (checked) join side.
    """
    found = raw.groupBy("env").agg(
        F.min(bucket_of(F.col("time_s"), spec.grid_s)).alias("b0"))
    rows = found.limit(MAX_LITERAL_ENVS + 1).collect()
    if len(rows) <= MAX_LITERAL_ENVS:
        return {r["env"]: r["b0"] for r in rows}
    return pin(found)


def with_origin(df: DataFrame, starts: dict[str, int] | DataFrame) -> DataFrame:
    if not isinstance(starts, dict):
        return df.join(starts, "env")
    b0 = F.lit(None).cast("long")
    for env, start in starts.items():
        b0 = F.when(F.col("env") == env, F.lit(start).cast("long")).otherwise(b0)
    return df.withColumn("b0", b0)


def to_grid(raw: DataFrame, spec: FleetSpec,
            starts: dict[str, int] | DataFrame | None = None) -> DataFrame:
    """Mean per (series, bucket) inside the window ``[b0, b0 + n_buckets)``.

    Rows outside the window collapse into one row per series with a NULL bucket:
    the series and its clip counts stay visible, at the cost of one row.
    """
    starts = origins(raw, spec) if starts is None else starts
    b = bucket_of(F.col("time_s"), spec.grid_s)
    rows = with_origin(clip_values(raw, spec), starts).select(
        "env", "series_id", "b0", "value", "is_high", "is_low",
        F.when((b >= F.col("b0")) & (b < F.col("b0") + spec.n_buckets), b).alias("bucket"),
    )
    return rows.groupBy("env", "series_id", "b0", "bucket").agg(
        F.avg(F.when(F.col("bucket").isNotNull(), F.col("value"))).alias("y"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("is_high").alias("n_high"),
        F.count_if("is_low").alias("n_low"),
    )


def regularise(gridded: DataFrame, spec: FleetSpec, max_gap: int | None = None) -> DataFrame:
    """Every bucket of the window as a row, short inner gaps filled linearly.

    Output: ``env, series_id, b0, bucket, off, y_obs, y, is_interp`` plus raw-row
    counts.  A gap is filled when it has at most ``max_gap`` buckets and a measured
    bucket of the window on both sides.  Rows that measure nothing inside the
    window are passed through with a NULL bucket; see :func:`cells`.
    """
    k = spec.max_gap if max_gap is None else max_gap
    w = series_window()
    measured = F.col("bucket").isNotNull() & F.col("y").isNotNull()
    g = (
        gridded.withColumn("in_window", F.col("bucket").isNotNull())
        .withColumn("bucket", F.when(measured, F.col("bucket")))
        .withColumn("_pb", F.lag("bucket").over(w))
        .withColumn("_nb", F.lead("bucket").over(w))
        .withColumn("_ny", F.lead("y").over(w))
    )
    end = F.col("b0") + spec.n_buckets
    first = F.when(F.col("_pb").isNull(), F.col("b0")).otherwise(F.col("bucket"))
    last = F.coalesce(F.col("_nb"), end) - 1
    g = g.withColumn("cell", F.explode(
        F.when(F.col("bucket").isNotNull(), F.sequence(first, last))
        .otherwise(F.array(F.lit(None).cast("long")))
    ))
    here = F.col("cell") == F.col("bucket")
    fillable = (F.col("cell") > F.col("bucket")) & (F.col("_nb") - F.col("bucket") - 1 <= k)
    share = (F.col("cell") - F.col("bucket")) / (F.col("_nb") - F.col("bucket"))
    y_obs = F.when(here, F.col("y"))
    filled = F.when(fillable, F.col("y") + (F.col("_ny") - F.col("y")) * share)
    own = F.col("cell").isNull() | here

    def once(c: str):
        return F.when(own, F.col(c)).otherwise(F.lit(0)).alias(c)

    return g.select(
        "env", "series_id", "b0", F.col("cell").alias("bucket"),
        (F.col("cell") - F.col("b0")).alias("off"),
        y_obs.alias("y_obs"), F.coalesce(y_obs, filled).alias("y"),
        F.coalesce(fillable, F.lit(False)).alias("is_interp"),
        "in_window", once("n_rows"), once("n_high"), once("n_low"),
    )


def cells(regular: DataFrame) -> DataFrame:
    """The grid rows of :func:`regularise` in the shape of the processed table."""
    return regular.where(F.col("bucket").isNotNull()).select(
        "env", "series_id", "b0", "bucket", "off", "y_obs", "y", "is_interp")


def fleet_grid(raw: DataFrame, spec: FleetSpec, max_gap: int | None = None) -> DataFrame:
    """Raw rows to regular series in one call."""
    return cells(regularise(to_grid(raw, spec), spec, max_gap))


def apply_window(df: DataFrame, b0: int, n_buckets: int) -> DataFrame:
    """Half-open bucket range; a plain range predicate, so parquet scans prune on it."""
    return df.where((F.col("bucket") >= b0) & (F.col("bucket") < b0 + n_buckets))


def reindex(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Complete sparse ``(env, series_id, bucket, ...)`` rows to each series' own bucket range.

    ``bounds`` has ``env, series_id, lo, hi`` (both inclusive).
    """
    frame = bounds.select("env", "series_id", F.explode(F.sequence("lo", "hi")).alias("bucket"))
    return frame.join(df, ["env", "series_id", "bucket"], "left")


def assert_contiguous(df: DataFrame) -> DataFrame:
    """Fail the job when two rows of a series are not exactly one bucket apart.

    Lag by row equals lag by time only on such a grid.
    """
    step = F.col("bucket") - F.lag("bucket").over(series_window())
    return df.withColumn("_step", step).withColumn(
        "bucket",
        F.when(F.col("_step").isNull() | (F.col("_step") == 1), F.col("bucket")).otherwise(
            F.raise_error(F.concat(
                F.lit("grid of series "), F.col("series_id"), F.lit(" has step "),
                F.col("_step").cast("string"), F.lit(" before bucket "),
                F.col("bucket").cast("string"))).cast("long")),
    ).drop("_step")


def grid_breaks(df: DataFrame) -> DataFrame:
    """Per series: rows, first and last bucket, and steps that are not exactly one bucket."""
    step = F.col("bucket") - F.lag("bucket").over(series_window())
    return df.withColumn("_step", step).groupBy("env", "series_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("bucket").alias("first_bucket"),
        F.max("bucket").alias("last_bucket"),
        F.count_if(F.col("_step") != 1).alias("n_breaks"),
    )
