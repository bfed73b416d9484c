"""Aggregate expressions for the shape statistics, bias-corrected as in sample statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(c: Column) -> Column:
    """G1 = sqrt(n(n-1))/(n-2) * g1; NULL below 3 values, 0 for a constant column."""
    n = F.count(c).cast("double")
    corrected = F.try_divide(F.sqrt(n * (n - 1.0)), n - 2.0) * F.skewness(c)
    return F.when(n >= 3.0, F.when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(corrected))


def sample_kurtosis(c: Column) -> Column:
    """G2 = (n-1)/((n-2)(n-3)) * ((n+1) g2 + 6); NULL below 4 values, 0 for a constant column."""
    n = F.count(c).cast("double")
    factor = F.try_divide(n - 1.0, (n - 2.0) * (n - 3.0))
    corrected = factor * ((n + 1.0) * F.kurtosis(c) + 6.0)
    return F.when(n >= 4.0, F.when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(corrected))


def pearson(a: Column, b: Column) -> Column:
    """Pairwise-complete correlation; NULL when either side is constant (``corr`` would throw)."""
    both_a = F.when(b.isNotNull(), a)
    both_b = F.when(a.isNotNull(), b)
    spread = F.stddev_samp(both_a) * F.stddev_samp(both_b)
    return F.try_divide(F.covar_samp(a, b), spread)
