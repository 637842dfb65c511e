"""Chi-square upper tail, without rescaling the expected values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_tail(statistic: float, df: int) -> float:
    """P(X >= statistic); NaN for no degrees of freedom or an undefined statistic."""
    if df < 1 or math.isnan(statistic):
        return math.nan
    if statistic <= 0:
        return 1.0
    if math.isinf(statistic):
        return 0.0
    half = statistic / 2
    if df % 2 == 0:
        term = total = 1.0
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    total, term = math.erfc(math.sqrt(half)), math.sqrt(2 * statistic / math.pi) * math.exp(-half)
    for i in range(1, (df + 1) // 2):
        total += term
        term *= statistic / (2 * i + 1)
    return total


def chi2_p(observed: np.ndarray, expected: np.ndarray) -> float:
    with np.errstate(divide="ignore", invalid="ignore"):
        s = float(np.sum((observed - expected) ** 2 / expected))
    return chi2_tail(s, len(observed) - 1)


def chi2_tail_of(statistic: Column, df: Column) -> Column:
    """The upper tail as a column, in Arrow batches."""

    @F.pandas_udf("double")
    def tail(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([chi2_tail(float(x), int(n)) for x, n in zip(s, k)])

    return tail(statistic, df)
