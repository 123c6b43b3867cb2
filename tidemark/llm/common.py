"""Helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as a regular expression class.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows whose texts a task unpacks together, and their bytes.
ROWS, BYTES = 1000, 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def folded(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns of a table but ``without`` as one, so that their names cannot meet those of an operator."""
    names = [c for c in df.columns if c not in without]
    return (F.struct(*map(quoted, names)) if names else F.struct(F.lit(None).cast("int").alias("none"))).alias("kept")


def unfolded(df: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    """The columns that ``folded`` put together, of the table that it was given."""
    return [F.col("kept").getField(c).alias(c) for c in df.columns if c not in without]


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back, so that a lost executor costs no recomputation.

    The folder is the one in ``spark.checkpoint.dir``. Only where none is set and all runs on one machine (tests) a temporary
    one is used; on a cluster other machines would not see it, which is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _is_scan(df: DataFrame) -> bool:
    """Whether each row of a table is one of a Parquet file: nothing but columns and conditions above one scan."""
    plan = df._jdf.queryExecution().analyzed().numberedTreeString()
    nodes = re.findall(r"^\d+ [\s:+-]*(\w+)", plan, re.M)
    return "_metadata" not in df.columns and nodes[-1:] == ["Relation"] and set(nodes[:-1]) <= {"Project", "Filter"} and " parquet" in plan


def keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """The table with an own key for each row, the same in every job, and the name of that column; ids may be null or repeat.

    A row of a Parquet file is known by its file and place. Other tables are written with a number for each row first.
    """
    name = "row_key"
    while name in {c.lower() for c in df.columns}:
        name += "_"
    if _is_scan(df):
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        return df.withColumn(name, place), name
    return settle(df.withColumn(name, F.monotonically_increasing_id())), name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row.

    Spark copies an expression into every place that uses it, also into lambdas, where it would be computed
    again for each element. A lambda's argument is computed once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark a settled table for broadcasting if it has at most ``rows`` rows; otherwise joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df


def batches_of_texts(batches: Iterator, column: int) -> Iterator:
    """Parts of the batches, cut by rows and by bytes of text, with their texts (null: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for whole in batches:
        sizes = pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy()
        at = 0
        while at < whole.num_rows:
            end, size = at + 1, sizes[at]
            while end < whole.num_rows and end - at < ROWS and size + sizes[end] <= BYTES:
                size += sizes[end]
                end += 1
            part = whole.slice(at, end - at)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            at = end
        pa.default_memory_pool().release_unused()
