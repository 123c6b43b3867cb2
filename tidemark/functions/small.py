"""Small dimension tables, used as join sides only after their size was measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PINNED_ROWS = 10_000


def pin(df: DataFrame, max_rows: int = MAX_PINNED_ROWS) -> DataFrame:
    """Turn a table of at most ``max_rows`` rows into a broadcast literal, else return it as is.

    A larger table stays a shuffled join side; the result is the same.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(table, df.schema))
