"""Deterministic samples and groupings.

Order is the md5 of seed and id: the same rows come out whatever the physical
order of the input or the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import numbered
from tidemark.functions.small import pin

SEED = 42


def draw_key(*ids: str, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def quantile_strata(df: DataFrame, value: str, id_col: str, k: int = 5,
                    out: str = "stratum") -> DataFrame:
    """Equal-frequency strata 0..k-1 by rank, ties broken by id.

    Edges are the linear quantiles of the ranks 1..n, which differs from ``ntile``
    when k does not divide n.
    """
    ranked = numbered(df, [F.col(value), F.col(id_col)], "_rn")
    n = df.count()
    if n <= 1:
        return ranked.withColumn(out, F.lit(0).cast("long")).drop("_rn")
    pos = (F.col("_rn") - 1) * k / F.lit(n - 1)
    return ranked.withColumn(out, F.greatest(F.ceil(pos) - 1, F.lit(0)).cast("long")).drop("_rn")


def _draw(df: DataFrame, stratum: str, ids: list[str], quotas: DataFrame, seed: int) -> DataFrame:
    """The ``quota`` rows with the lowest keys in each stratum, exactly.

    Keys are uniform hex strings.  Counting rows per key prefix tells up to which
    prefix the quota reaches; only those rows are shuffled and ordered, so no task
    sees a whole stratum.
    """
    keyed = df.withColumn("_key", draw_key(*ids, seed=seed))
    per_prefix = keyed.groupBy(stratum, F.substring("_key", 1, 4).alias("_p")).count()
    run = F.sum("count").over(Window.partitionBy(stratum).orderBy("_p"))
    reach = (
        per_prefix.withColumn("_run", run).join(quotas, stratum)
        .groupBy(stratum, "quota")
        .agg(F.coalesce(F.min(F.when(F.col("_run") >= F.col("quota"), F.col("_p"))), F.lit("g"))
             .alias("_cut"))
    )
    w = Window.partitionBy(stratum).orderBy("_key", *ids)
    return (
        keyed.join(pin(reach), stratum).where(F.substring("_key", 1, 4) <= F.col("_cut"))
        .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.col("quota"))
        .select(*df.columns)
    )


def sample_per_stratum(df: DataFrame, stratum: str, id_col: str, k: int,
                       seed: int = SEED) -> DataFrame:
    """``k`` members of each stratum, all members of a smaller one."""
    quotas = pin(df.select(stratum).distinct().withColumn("quota", F.lit(k)))
    return _draw(df, stratum, [id_col], quotas, seed)


def row_quotas(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """Proportional share of ``n`` per stratum, the remainder to the largest stratum."""
    counts = pin(df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_rows")))
    every = Window.partitionBy(F.lit(1))
    share = F.floor(F.lit(n) * F.col("n_rows") / F.sum("n_rows").over(every))
    biggest = F.row_number().over(every.orderBy(F.col("n_rows").desc(), stratum)) == 1
    q = counts.withColumn("_q", share).withColumn("_big", biggest)
    rest = F.lit(n) - F.sum("_q").over(every)
    return q.select(
        stratum, "n_rows",
        F.least(F.col("_q") + F.when(F.col("_big"), rest).otherwise(0), F.col("n_rows")).alias("quota"))


def proportional_rows(df: DataFrame, stratum: str, ids: list[str], n: int,
                      seed: int = SEED) -> DataFrame:
    """At most ``n`` rows, keeping the strata's proportions; drawn by key, not by position.

    The same ``(series, offset)`` keys come out for every horizon that shares them.
    """
    quotas = pin(row_quotas(df, stratum, n).select(stratum, "quota"))
    return _draw(df, stratum, ids, quotas, seed)


def halves_and_groups(ids: DataFrame, id_col: str, n_single: int | None, group_size: int,
                      single_env: str, group_env: str, seed: int = SEED) -> DataFrame:
    """Shuffle ids; the first ``n_single`` stay single, the next form groups, the rest is left out.

    Output ``env, series_id, member``; ``env`` is ``rest`` for members of no group. Group numbers have two digits at
    least and as many as they need. Ids must be unique. ``n_single`` None means half of the ids.
    """
    n, distinct = ids.agg(F.count(F.lit(1)), F.count_distinct(id_col)).first()
    if distinct < n:
        raise ValueError(f"{id_col} is not unique: {n} rows, {distinct} ids")
    n_single = n // 2 if n_single is None else n_single
    n_groups = max(0, n - n_single) // group_size
    order = numbered(ids.select(F.col(id_col).alias("member")).withColumn("_key", draw_key("member", seed=seed)),
                     [F.col("_key"), F.col("member")], "_rn")
    g = F.floor((F.col("_rn") - n_single - 1) / group_size)
    single = F.col("_rn") <= n_single
    return order.select(
        F.when(single, single_env).when(g < n_groups, group_env).otherwise("rest").alias("env"),
        F.when(single, F.col("member"))
        .when(g < n_groups, F.concat(F.lit(f"{group_env}_"), F.format_string("%02d", g)))
        .otherwise("").alias("series_id"),
        "member")


def strict_group_mean(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean series of each group; missing where any member is missing.

    ``df`` has ``series_id, bucket, off, y, is_interp``; ``groups`` maps members to
    ``env, series_id``.  A group's bucket collects a handful of rows.
    """
    g = groups.where(F.col("env") != "rest").select(F.col("env").alias("_env"), F.col("series_id").alias("_sid"), "member")
    size = Window.partitionBy("_env", "_sid")
    g = g.withColumn("_k", F.count(F.lit(1)).over(size))
    rows = df.join(g, df["series_id"] == g["member"])
    full = F.count("y") == F.max("_k")
    return rows.groupBy(F.col("_env").alias("env"), F.col("_sid").alias("series_id"), "bucket", "off").agg(
        F.when(full, F.avg("y")).alias("y"),
        (F.bool_or("is_interp") & full).alias("is_interp"))
