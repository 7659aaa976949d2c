"""Arrow functions for what Spark SQL lacks: normal tails and Fisher's exact test."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore")


def _fisher(a: int, b: int, c: int, d: int) -> float:
    """Terms that are nothing beside the largest one (under e^-745 of it) are left out: what is left has some tens of standard deviations, however large the counts are."""
    n, row, col = a + b + c + d, a + b, a + c
    if n == 0:
        return 1.0
    low, high, other = max(0, row + col - n), min(row, col), n - row - col
    log_p = lambda k: -(math.lgamma(k + 1) + math.lgamma(row - k + 1) + math.lgamma(col - k + 1) + math.lgamma(other + k + 1))
    mode = min(max((row + 1) * (col + 1) // (n + 2), low), high)
    least = log_p(mode) - 746
    # log_p rises up to the mode and falls behind it
    first = bisect.bisect_left(range(low, mode), True, key=lambda k: log_p(k) >= least) + low
    last = bisect.bisect_left(range(mode + 1, high + 1), True, key=lambda k: log_p(k) < least) + mode
    if not first <= a <= last:
        return 0.0
    k = np.arange(first, last, dtype=np.float64)
    p = np.concatenate([[0.0], np.cumsum(np.log((row - k) * (col - k) / ((k + 1) * (other + k + 1))))])
    p = np.exp(p - p.max())
    return min(1.0, float(p[p <= p[a - first] * (1 + 1e-7)].sum() / p.sum()))


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided Fisher exact p of 2x2 counts; meant for aggregated tables."""
    return pd.Series([None if any(pd.isna(v) for v in x) else _fisher(*map(int, x)) for x in zip(a, b, c, d)], dtype="float64")


def sign_test_table(spark: SparkSession, n: int) -> DataFrame:
    """(k, p): two-sided binomial sign-test p for k of n at one half; n + 1 rows."""
    tail = np.cumsum([math.comb(n, k) for k in range(n + 1)], dtype=object)
    rows = [(k, min(1.0, 2 * float(tail[min(k, n - k)]) / 2**n)) for k in range(n + 1)]
    return spark.createDataFrame(rows, "k long, p double")
