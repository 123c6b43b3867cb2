"""Raw utilisation logs as ``env, series_id, time_s, value`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_COLUMNS = ["env", "series_id", "time_s", "value"]

# The column layout of the two log formats.
VM_TIME, VM_VALUE, VM_SEPARATOR = "Timestamp [ms]", "CPU usage [%]", ";\t"
MACHINE_SCHEMA = T.StructType([
    T.StructField("machine_id", T.StringType()),
    T.StructField("time_stamp", T.LongType()),
    T.StructField("cpu_util_percent", T.DoubleType()),
    T.StructField("mem_util_percent", T.DoubleType()),
    T.StructField("mem_gps", T.DoubleType()),
    T.StructField("mkpi", T.DoubleType()),
    T.StructField("net_in", T.DoubleType()),
    T.StructField("net_out", T.DoubleType()),
    T.StructField("disk_io_percent", T.DoubleType()),
])
MACHINE_SENTINELS = {"disk_io_percent": [-1, 101]}
MACHINE_UNUSED = ["mem_gps", "mkpi"]


def series_id(env: str, path: Column, month: str | Column | None = None,
              month_required: bool = False) -> Column:
    """``env_stem`` or ``env_month_stem``; file names may repeat between months."""
    if month is None and month_required:
        raise ValueError(f"environment {env} repeats file names between months: a month is required")
    stem = F.regexp_extract(path, r"([^/]+)\.csv$", 1)
    parts = [F.lit(env)]
    if month is not None:
        parts.append(F.lit(month) if isinstance(month, str) else month)
    return F.concat_ws("_", *parts, stem)


def month_of(path: Column) -> Column:
    """Name of the folder a log file lies in."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+\.csv$", 1)


def read_vm_logs(spark: SparkSession, path: str, env: str, month: str | Column | None = None,
                 month_required: bool = False, time_col: str = VM_TIME, value_col: str = VM_VALUE,
                 ) -> DataFrame:
    """One CSV per machine.  Times are seconds although the header says otherwise.

    Header names may carry blanks; rows whose time or value is not a number are dropped.
    """
    raw = spark.read.option("sep", VM_SEPARATOR).option("header", True).csv(path)
    named = {c.strip(): c for c in raw.columns}
    missing = [c for c in (time_col, value_col) if c not in named]
    if missing:
        raise ValueError(f"missing columns {missing}; file has {sorted(named)}")

    def number(c: str) -> Column:
        return F.trim(F.col(f"`{named[c]}`")).try_cast("double")

    file = F.col("_metadata.file_path")
    rows = raw.select(
        F.lit(env).alias("env"),
        series_id(env, file, month, month_required).alias("series_id"),
        F.floor(number(time_col)).cast("long").alias("time_s"), number(value_col).alias("value"))
    return rows.where(F.col("time_s").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))


def read_machine_log(spark: SparkSession, path: str, env: str, ids: DataFrame | None = None) -> DataFrame:
    """Headerless machine log; only three of nine fields are parsed, only listed ids are kept.

    The id list is read from a small file whose size Spark knows, so it decides on
    broadcasting by itself.
    """
    rows = spark.read.schema(MACHINE_SCHEMA).csv(path).select(
        "machine_id", "time_stamp", "cpu_util_percent")
    if ids is not None:
        rows = rows.join(ids, "machine_id", "left_semi")
    return rows.select(
        F.lit(env).alias("env"), F.concat_ws("_", F.lit(env), "machine_id").alias("series_id"),
        F.col("time_stamp").alias("time_s"), F.col("cpu_util_percent").alias("value"))


def read_machine_table(spark: SparkSession, path: str) -> DataFrame:
    """All fields, with marker values masked and unused fields dropped."""
    from tidemark.operators.clean import drop_columns, mask_sentinels

    full = spark.read.schema(MACHINE_SCHEMA).csv(path)
    return drop_columns(mask_sentinels(full, MACHINE_SENTINELS), MACHINE_UNUSED)


def read_frozen_ids(spark: SparkSession, path: str) -> DataFrame:
    """Frozen id list: one id per line, blank lines and ``#`` comments skipped."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("machine_id")).where(
        (F.col("machine_id") != "") & ~F.col("machine_id").startswith("#"))


def machine_means(rows: DataFrame) -> DataFrame:
    """Mean level per machine, the basis of the frozen sample."""
    return rows.groupBy("env", "series_id").agg(
        F.avg("value").alias("mean"), F.count("value").alias("n_values")).where(F.col("n_values") > 0)


def fingerprint(spark: SparkSession, path: str, md5_up_to: int = 64 << 20) -> DataFrame:
    """Per file: folder, name, bytes, and the md5 of files small enough to be read whole.

    The length test reaches the reader, so a large file is listed but never loaded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    where = [F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"),
             F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes")]
    small = files.where(F.col("length") <= md5_up_to).select(*where, F.md5("content").alias("md5"))
    large = files.where(F.col("length") > md5_up_to).select(*where, F.lit(None).cast("string").alias("md5"))
    return small.unionByName(large)


def compare_fingerprint(files: DataFrame, folders: DataFrame, samples: DataFrame) -> DataFrame:
    """Check folders (``folder, n_files, total_bytes``) and sample files (``folder, file, md5``).

    A file that is there but too large to have been hashed is ``not_hashed``.
    """
    got = files.groupBy("folder").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("bytes").alias("_b"))
    f = folders.join(got, "folder", "left").select(
        F.concat(F.lit("folder "), "folder").alias("check"),
        F.when(F.col("_n").isNull(), "missing").when(F.col("_n") != F.col("n_files"), "file_count_differs")
        .when(F.col("_b") != F.col("total_bytes"), "size_differs").otherwise("ok").alias("status"))
    s = samples.join(files.select("folder", "file", F.col("bytes").alias("_n"), F.col("md5").alias("_m")), ["folder", "file"], "left")
    s = s.select(
        F.concat(F.lit("file "), "folder", F.lit("/"), "file").alias("check"),
        F.when(F.col("_n").isNull(), "missing").when(F.col("_m").isNull(), "not_hashed")
        .when(F.col("_m") != F.col("md5"), "md5_differs")
        .otherwise("ok").alias("status"))
    return f.unionByName(s)
