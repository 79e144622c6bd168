"""Tail probabilities of the drift tests, applied to one number per feature."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kolmogorov(statistic: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Two-sided asymptotic p-value of the two-sample KS statistic: an alternating series."""
    size = n1.cast("double") * n2.cast("double") / (n1 + n2).cast("double")
    x = size * statistic * statistic
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * x),
    )
    # For very small arguments the series converges slowly and the probability is 1.
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * total))
    return F.when(x < 0.04, F.lit(1.0)).when(x.isNotNull(), clipped)


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    # Continued fraction, evaluated from the front.
    b = x + 1 - a
    c = 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if d else 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def chi_square(statistic: pd.Series, degrees: pd.Series) -> pd.Series:
    return pd.Series([
        None if pd.isna(s) or pd.isna(d) else 1.0 if d < 1 else _upper_gamma(d / 2, s / 2)
        for s, d in zip(statistic, degrees)
    ], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2))).astype("float64")
