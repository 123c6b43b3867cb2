"""Exact ranks, percentiles and numbering of groups too large for one task.

``percentile``, ``rank`` and ``row_number`` bring a whole group into one task.
That is right for a bounded group and wrong for, say, all series of an
environment.  The functions here measure the input first.  Small inputs take the
built-in way.  Large ones are cut into value ranges, so that a group is spread
over as many tasks as it needs and only the row counts of the ranges are
combined.  Both ways are exact and give the same result.
"""

from __future__ import annotations

import math
import uuid

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Most rows a single window partition or percentile buffer is allowed to hold.
ROWS_PER_TASK = 1_000_000
MAX_BINS = 10_000


_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist a table that is read more than once; lost blocks are recomputed from lineage."""
    if df.is_cached:
        return df
    _kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def release() -> None:
    """Give up every table kept so far, once the results that read them are stored.

    A result still to be computed stays right; it is computed from its sources again.
    """
    while _kept:
        _kept.pop().unpersist()


def stage_folder(spark: SparkSession) -> str | None:
    """Shared folder for stage tables, as the cluster names it."""
    return spark.conf.get("spark.checkpoint.dir", None)


def settle(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A table that many jobs will read: written into the cluster's checkpoint folder if it names one.

    What is written outlives the executors that made it, cuts the lineage and is read
    back with column and partition pruning.  Without ``spark.checkpoint.dir`` the table
    is only persisted.
    """
    spark = df.sparkSession
    folder = stage_folder(spark)
    if not folder:
        return keep(df)
    path = f"{folder.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    # Partition values come back typed as written, not as inferred from folder names.
    back = spark.read.schema(df.schema).parquet(path)
    return back.select(*df.columns)


def is_small(df: DataFrame, rows_per_task: int | None = None) -> bool:
    """Whether the whole table fits one task; computes and keeps it on the way.

    The answer can be passed as ``small`` to the functions below for this table and
    any part of it, which saves them their own count.
    """
    return keep(df).count() <= (rows_per_task or ROWS_PER_TASK)


def _split_points(df: DataFrame, col: str, rows_per_task: int | None) -> list[float]:
    """Inner edges of value ranges with about ``rows_per_task`` rows; none for a small table."""
    rows_per_task = rows_per_task or ROWS_PER_TASK
    n = df.count()
    if n <= rows_per_task:
        return []
    bins = min(MAX_BINS, math.ceil(2 * n / rows_per_task))
    probs = [i / bins for i in range(1, bins)]
    return sorted(set(df.approxQuantile(col, probs, 1 / (4 * bins))))


def _with_bin(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    splits = [-float("inf"), *edges, float("inf")]
    return Bucketizer(splits=splits, inputCol=col, outputCol="_bin").transform(df)


def _bin_offsets(binned: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Rows per (keys, bin), rows in lower bins, rows of the key: at most MAX_BINS rows a key."""
    per_bin = binned.groupBy(*keys, "_bin").agg(F.sum(weight).alias("_in_bin"))
    w = Window.partitionBy(*keys).orderBy("_bin")
    return (
        per_bin
        .withColumn("_offset", F.sum("_in_bin").over(w) - F.col("_in_bin"))
        .withColumn("n_total", F.sum("_in_bin").over(Window.partitionBy(*keys)))
    )


def value_ranks(
    df: DataFrame, keys: list[str], col: str, sums: dict[str, Column] | None = None,
    rows_per_task: int | None = None, small: bool | None = None,
) -> DataFrame:
    """One row per (keys, distinct value) with its place among the rows of the key.

    Adds ``n`` (rows with this value), ``n_below`` (rows with a smaller value),
    ``n_total``, ``avg_rank`` (ties share the mean rank) and any extra ``sums``.
    Equal values are collapsed before anything is ordered, so a value that a
    third of the rows share costs one row.
    """
    df = df.where(F.col(col).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(a) for a, c in (sums or {}).items()]]
    df = df if small else keep(df)
    edges = [] if small else _split_points(df, col, rows_per_task)
    if not edges:
        d = df.groupBy(*keys, col).agg(*aggs)
        w = Window.partitionBy(*keys).orderBy(col)
        d = (
            d.withColumn("n_below", F.sum("n").over(w) - F.col("n"))
            .withColumn("n_total", F.sum("n").over(Window.partitionBy(*keys)))
        )
    else:
        d = _with_bin(df.groupBy(*keys, col).agg(*aggs), col, edges)
        offsets = _bin_offsets(_with_bin(df, col, edges), keys, F.lit(1)).drop("_in_bin")
        w = Window.partitionBy(*keys, "_bin").orderBy(col)
        d = (
            d.withColumn("_run", F.sum("n").over(w) - F.col("n"))
            .join(_null_safe(offsets, keys), _on(d, keys), "inner")
            .withColumn("n_below", F.col("_offset") + F.col("_run"))
            .drop("_bin", "_offset", "_run", *[f"_r_{k}" for k in keys], "_r__bin")
        )
    return d.withColumn("avg_rank", F.col("n_below") + (F.col("n") + 1) / 2)


def _null_safe(right: DataFrame, keys: list[str]) -> DataFrame:
    return right.withColumnsRenamed({k: f"_r_{k}" for k in [*keys, "_bin"]})


def _on(left: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in [*keys, "_bin"]:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return cond


def quantiles(
    df: DataFrame, keys: list[str], col: str, probs: dict[str, float],
    rows_per_task: int | None = None, small: bool | None = None,
) -> DataFrame:
    """Exact linearly interpolated percentiles per key, plus ``n`` (non-NULL rows).

    Keys whose values are all NULL keep a row with NULL percentiles.  On the large
    path only the value ranges that hold a wanted position are ordered.
    """
    df = df.select(*keys, col) if small else keep(df.select(*keys, col))
    edges = [] if small else _split_points(df, col, rows_per_task)
    if not edges:
        return df.groupBy(*keys).agg(
            *[F.percentile(col, F.lit(p)).alias(name) for name, p in probs.items()],
            F.count(col).alias("n"),
        )
    groups = df.groupBy(*keys).agg(F.count(col).alias("n"))
    binned = _with_bin(df.where(F.col(col).isNotNull()), col, edges)
    offsets = _bin_offsets(binned, keys, F.lit(1))
    pos = {name: p * (F.col("n_total") - 1) for name, p in probs.items()}
    wanted = F.lit(False)
    for c in pos.values():
        for r in (F.floor(c), F.ceil(c)):
            wanted = wanted | ((r >= F.col("_offset")) & (r < F.col("_offset") + F.col("_in_bin")))
    hit = _null_safe(offsets.where(wanted).drop("_in_bin"), keys)
    d = (
        binned.join(hit, _on(binned, keys), "inner")
        .groupBy(*keys, "_bin", "_offset", "n_total", col).agg(F.count(F.lit(1)).alias("_n"))
    )
    w = Window.partitionBy(*keys, "_bin").orderBy(col)
    below = F.col("_offset") + F.sum("_n").over(w) - F.col("_n")
    d = d.withColumn("_below", below)

    def at(r: Column) -> Column:
        return F.max(F.when((r >= F.col("_below")) & (r < F.col("_below") + F.col("_n")), F.col(col)))

    cols = []
    for name, c in pos.items():
        cols += [at(F.floor(c)).alias(f"_lo_{name}"), at(F.ceil(c)).alias(f"_hi_{name}"),
                 F.max(c - F.floor(c)).alias(f"_f_{name}")]
    picked = d.groupBy(*keys).agg(*cols)
    for name in probs:
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        picked = picked.withColumn(name, lo + (hi - lo) * F.col(f"_f_{name}"))
    picked = picked.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *probs)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return groups.join(picked, cond, "left").select(*keys, *probs, "n")


def medians(df: DataFrame, keys: list[str], cols: list[str], small: bool | None = None) -> DataFrame:
    """Exact medians of several columns per key, as ``<column>_p50``."""
    if small is None:
        small = is_small(df)
    if small:
        return df.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).alias(f"{c}_p50") for c in cols])
    long = df.select(*keys, *cols).unpivot(keys, cols, "_column", "_value")
    q = quantiles(long, [*keys, "_column"], "_value", {"p50": 0.5})
    wide = q.groupBy(*keys).pivot("_column", cols).agg(F.first("p50"))
    return wide.withColumnsRenamed({c: f"{c}_p50" for c in cols})


def numbered(
    df: DataFrame, order: list[Column], out: str = "rn", rows_per_task: int | None = None,
) -> DataFrame:
    """1-based position of every row in a total order over the whole table.

    A large table is range-partitioned and sorted; a row's position is its place
    in its partition plus the rows of the earlier partitions (one count each).
    """
    df = keep(df)
    rows_per_task = rows_per_task or ROWS_PER_TASK
    n = df.count()
    if n <= rows_per_task:
        return df.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long"))
    parts = max(2, math.ceil(2 * n / rows_per_task))
    placed = keep(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
        .withColumn("_idx", F.col("_id").bitwiseAND((1 << 33) - 1))
    )
    # One row per range partition, so the unpartitioned window is over `parts` rows.
    w = Window.orderBy("_part")
    counts = placed.groupBy("_part").count().select(
        "_part", (F.sum("count").over(w) - F.col("count")).alias("_before"))
    return (
        placed.join(counts, "_part")
        .withColumn(out, (F.col("_before") + F.col("_idx") + 1).cast("long"))
        .drop("_id", "_part", "_idx", "_before")
    )
