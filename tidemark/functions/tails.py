"""Tail probabilities Spark SQL has no function for: Arrow-batched UDFs and, for small samples, exact counts.

They only ever see one row per statistical test.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def two_sided_normal(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|) of a standard normal variable."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))


def _t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|), integrating Student's density over the angle atan(t / sqrt(df)).

    With t = sqrt(df) tan(a) the density becomes cos(a)^(df-1), smooth on a finite
    range, where Gauss-Legendre quadrature converges quickly.
    """
    import numpy as np

    start = math.atan2(abs(t), math.sqrt(df))
    # Almost all mass lies within a few multiples of 1/sqrt(df) of the start.
    stop = min(math.pi / 2, start + 40 / math.sqrt(df))
    x, w = np.polynomial.legendre.leggauss(200)
    a = (stop - start) / 2 * x + (stop + start) / 2
    body = (stop - start) / 2 * float(np.sum(w * np.cos(a) ** (df - 1)))
    norm = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return min(1.0, 2 * norm * body)


@F.pandas_udf(T.DoubleType())
def two_sided_student(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|) of Student's t with ``df`` degrees of freedom."""
    return pd.Series([
        None if pd.isna(v) or pd.isna(k) or k < 1 else _t_two_sided(float(v), float(k))
        for v, k in zip(t, df)
    ], dtype="float64")


def two_sided_signed_rank(n: Column, statistic: Column) -> Column:
    """Twice the chance, at most 1, that the smaller rank sum of ``n`` untied differences is at most ``statistic``.

    Counts the sign patterns of each rank sum, a rank after the other: 2 ** n patterns in all, so doubles hold the counts
    exactly up to n = 53.
    """
    zero = F.lit(0.0)
    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1.0)), lambda f, k: F.transform(
        F.sequence(F.lit(0), F.size(f) + k - 1), lambda s: F.coalesce(F.get(f, s), zero) + F.coalesce(F.get(f, s - k), zero)))
    below = F.aggregate(F.slice(counts, F.lit(1), F.floor(statistic).cast("int") + 1), zero, lambda total, x: total + x)
    return F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n))
