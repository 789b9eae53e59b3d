"""Tail probabilities for the independence tests, evaluated on one row per test."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi2_tail(stat: float, dof: int) -> float:
    """P(chi-square with ``dof`` degrees > stat) by its finite sum; no freedom means certainty."""
    if dof <= 0 or stat <= 0:
        return 1.0
    half = stat / 2.0
    if dof % 2:
        total = math.erfc(math.sqrt(half))
        powers = [i + 0.5 for i in range((dof - 1) // 2)]
    else:
        total = 0.0
        powers = [float(i) for i in range(dof // 2)]
    total += sum(math.exp(p * math.log(half) - half - math.lgamma(p + 1)) for p in powers)
    return min(1.0, total)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


@F.pandas_udf(T.DoubleType())
def chi2_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(s, int(d)) for s, d in zip(stat, dof)])


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(normal_two_sided)
