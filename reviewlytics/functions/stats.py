"""Binomial intervals and exact McNemar p-values, one number pair per row.

Both are vectorised over Arrow batches. Their work per row grows with the
square root of the counts, because binomial mass further than 40 standard
deviations from the mean is below the smallest double.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_pmf(n: int, p: float, k: np.ndarray) -> np.ndarray:
    """Log of the binomial mass at a run of consecutive ``k``."""
    first = int(k[0])
    start = lgamma(n + 1) - lgamma(first + 1) - lgamma(n - first + 1)
    start += first * np.log(p) + (n - first) * np.log1p(-p)
    steps = np.log((n - k[:-1]) / (k[:-1] + 1.0)) + np.log(p) - np.log1p(-p)
    return start + np.concatenate(([0.0], np.cumsum(steps)))


def binomial_quantiles(n: int, hits: int, lower: float = 0.025, upper: float = 0.975):
    """Quantiles of the share of successes when ``n`` draws hit with hits/n."""
    if n == 0:
        return np.nan, np.nan
    p = hits / n
    if hits in (0, n):
        return p, p
    spread = int(40 * np.sqrt(n * p * (1 - p))) + 60
    k = np.arange(max(0, hits - spread), min(n, hits + spread) + 1, dtype=float)
    cdf = np.cumsum(np.exp(log_pmf(n, p, k)))
    cdf /= cdf[-1]
    at = [k[min(np.searchsorted(cdf, q - 1e-12), len(k) - 1)] / n for q in (lower, upper)]
    return at[0], at[1]


def mcnemar_p(n01: int, n10: int) -> float:
    """Two-sided exact binomial test of equal discordant counts."""
    n, low = n01 + n10, min(n01, n10)
    if n == 0 or n01 == n10:
        return 1.0
    k = np.arange(max(0, low - int(20 * np.sqrt(n)) - 60), low + 1, dtype=float)
    return float(min(1.0, 2.0 * np.exp(log_pmf(n, 0.5, k)).sum()))


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("low", "high")]))
def _interval(n: pd.Series, hits: pd.Series) -> pd.DataFrame:
    rows = [binomial_quantiles(int(a), int(b)) for a, b in zip(n, hits)]
    return pd.DataFrame(rows, columns=["low", "high"], dtype=float)


@F.pandas_udf(T.DoubleType())
def _mcnemar(n01: pd.Series, n10: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_p(int(a), int(b)) for a, b in zip(n01, n10)], dtype=float)


def share_interval(n: Column, hits: Column) -> Column:
    """95% percentile interval of a resampled share, as ``struct<low, high>``.

    Resampling n zero-one outcomes with replacement makes their sum binomial,
    so the limit of the percentile bootstrap needs the two counts only.
    """
    return _interval(n, hits)


def mcnemar_p_value(n01: Column, n10: Column) -> Column:
    return _mcnemar(n01, n10)
