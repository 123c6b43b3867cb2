"""Result tables: partitioned overwrite, keyed upsert, readers with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace exactly the partitions that ``df`` contains and keep the others."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by).parquet(path)
    )


def write_processed(df: DataFrame, path: str) -> None:
    write_partitioned(df.select("env", "series_id", "bucket", "y", "is_interp"), path, ["env"])


def upsert_catalog(catalog: DataFrame, path: str) -> None:
    """Replace the rows of the catalog's environments, keep the rest."""
    write_partitioned(catalog, path, ["env"])


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Feature matrices, one folder per environment, mode and horizon."""
    write_partitioned(matrix, path, ["env", "mode", "h"])


def save_series_table(df: DataFrame, table: str, buckets: int) -> None:
    """Regular series as a table bucketed by series and sorted by time.

    Feature matrices, metrics and joins per series then read it without a shuffle.
    """
    (
        df.write.mode("overwrite").bucketBy(buckets, "env", "series_id")
        .sortBy("env", "series_id", "bucket").saveAsTable(table)
    )


def read_table(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("header", True).format(fmt).load(path)


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _move(spark: SparkSession, src: str, dst: str) -> None:
    fs, a = _fs(spark, src)
    if not fs.rename(a, spark._jvm.org.apache.hadoop.fs.Path(dst)):
        raise OSError(f"cannot move {src} to {dst}")


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def recover(spark: SparkSession, path: str) -> None:
    """Bring back the previous version if a swap was interrupted between its two moves."""
    if not _exists(spark, path) and _exists(spark, path + "__previous"):
        _move(spark, path + "__previous", path)


def upsert(new: DataFrame, path: str, keys: list[str]) -> None:
    """Replace rows with the same key, append the rest.

    The merged table is written beside the old one and swapped in: a job must not
    overwrite what it is reading.
    """
    spark = new.sparkSession
    path = path.rstrip("/")
    recover(spark, path)
    if not _exists(spark, path):
        new.write.parquet(path)
        return
    old = spark.read.parquet(path)
    merged = old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(
        new, allowMissingColumns=True)
    merged.write.mode("overwrite").parquet(path + "__next")
    _drop(spark, path + "__previous")
    _move(spark, path, path + "__previous")
    _move(spark, path + "__next", path)
    _drop(spark, path + "__previous")
