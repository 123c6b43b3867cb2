"""Leakage-safe time split: a row belongs to a range only if ``t`` and ``t + h`` both do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import FleetSpec

PURGED = "purged"


def in_range(lo: int, hi: int) -> Column:
    return (F.col("off") >= lo) & (F.col("off") + F.col("h") < hi)


def split_label(spec: FleetSpec) -> Column:
    """``train``, ``val``, ``test``, or ``purged`` for a row that straddles a boundary."""
    label = F.lit(None).cast("string")
    for name, (lo, hi) in spec.bounds.items():
        label = F.when(in_range(lo, hi), F.lit(name)).otherwise(label)
    return F.coalesce(label, F.lit(PURGED))


def with_split(df: DataFrame, spec: FleetSpec) -> DataFrame:
    return df.withColumn("split", split_label(spec))


def fit_rows(df: DataFrame, spec: FleetSpec) -> DataFrame:
    """Rows the final model may learn from: train and validation, purged at the test edge."""
    return df.where(in_range(*spec.fit_bounds))


def test_rows(df: DataFrame, spec: FleetSpec) -> DataFrame:
    return df.where(in_range(*spec.bounds["test"]))


def with_folds(df: DataFrame, spec: FleetSpec) -> DataFrame:
    """Repeat each row for every rolling-origin fold it takes part in, as ``fold, role``.

    The fold list is a literal, so this is a map-side unfold and not a range join.
    """
    roles = []
    for fold, train_end, val_end in spec.fold_bounds:
        role = F.when(in_range(0, train_end), "train").when(in_range(train_end, val_end), "val")
        roles.append(F.struct(F.lit(fold).alias("fold"), role.alias("role")))
    parts = F.filter(F.array(*roles), lambda r: r["role"].isNotNull())
    return df.withColumn("_f", F.explode(parts)).select(*df.columns, "_f.fold", "_f.role")


def split_counts(df: DataFrame) -> DataFrame:
    """Rows per environment, horizon and split, purged rows included."""
    return df.groupBy("env", "h", "split").agg(F.count(F.lit(1)).alias("n_rows"))


def fold_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("env", "h", "fold", "role").agg(F.count(F.lit(1)).alias("n_rows"))
