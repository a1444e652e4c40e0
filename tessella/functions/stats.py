"""Statistics of paired and grouped columns that the built-in aggregates don't give as needed."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column | str) -> Column:
    """The column as a double, with NaN taken as missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows where both are present; null for fewer than two rows or a constant column.

    corr() divides by zero for constant columns; this doesn't.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def share(condition: Column) -> Column:
    """Percentage of rows where the condition holds; rows where it is null count as not."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def pearson_pvalue(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation r of n pairs; None where r is missing or n < 3."""
    if r is None or n < 3 or math.isnan(r):
        return None
    if abs(r) >= 1.0:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1.0 - r * r)
    return incomplete_beta(df / 2.0, 0.5, df / (df + t2))


def _pvalues(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([pearson_pvalue(None if pd.isna(a) else float(a), int(b)) for a, b in zip(r, n, strict=True)], dtype="float64")


def pvalue(r: Column, n: Column) -> Column:
    """Column of two-sided p-values; meant for the few rows of a correlation matrix."""
    return F.pandas_udf(_pvalues, "double")(r, n)


def bin_number(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Number of the bin of [lo, hi], from 0: bins are closed on the left, the last one on both sides; null outside.

    The bin that arithmetic gives is corrected by one where rounding put x on the wrong side of an edge, so equal values
    and edges fall where edges lo + i (hi - lo) / bins put them.
    """
    width = (hi - lo) / F.lit(float(bins))
    k = F.floor(F.try_divide(x - lo, width))
    edge = lambda i: lo + i.cast("double") * width
    k = F.when(x < edge(k), k - 1).when(x >= edge(k + 1), k + 1).otherwise(k)
    return F.when((x >= lo) & (x <= hi), F.greatest(F.least(k, F.lit(bins - 1)), F.lit(0)).cast("int"))
