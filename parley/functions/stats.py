"""Distribution functions that SQL lacks, as pandas UDFs over small result tables, and keyed digests."""

from __future__ import annotations

import hashlib
import hmac
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or 1e-300)
            c = 1 + term / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_two_sided(t: float, df: float) -> float:
    return beta_fraction(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_fraction(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def binomial_two_sided(b: int, c: int) -> float:
    """Exact McNemar p-value of discordant counts b and c."""
    n, low = b + c, min(b, c)
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(low + 1)]
    return min(1.0, 2 * sum(map(math.exp, logs)))


def _row_udf(f, *columns: Column) -> Column:
    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else float(f(*row)) for row in zip(*series)], dtype="float64")

    return run(*columns)


def p_normal(z: Column) -> Column:
    return _row_udf(normal_two_sided, z)


def p_t(t: Column, df: Column) -> Column:
    return _row_udf(t_two_sided, t, df)


def p_mcnemar(b: Column, c: Column) -> Column:
    return _row_udf(lambda x, y: binomial_two_sided(int(x), int(y)), b, c)


def keyed_id(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 of an id in hex; the key is the caller's, never stored here. Null stays null."""

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else hmac.new(key, str(x).encode(), hashlib.sha256).hexdigest())

    return run(value.cast("string"))
