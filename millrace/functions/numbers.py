"""Arithmetic on logarithms, and the logistic function, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_add(a: str | Column, b: str | Column) -> Column:
    """log(exp(a) + exp(b)) without leaving the logarithms; null stands for log(0)."""
    a, b = _col(a), _col(b)
    high, low = F.greatest(a, b), F.least(a, b)  # of one that is null they are the other
    return F.when(a.isNull() | b.isNull(), high).otherwise(high + F.log1p(F.exp(low - high)))


def logistic(score: str | Column) -> Column:
    """1 / (1 + exp(-score))."""
    return 1 / (1 + F.exp(-_col(score)))
