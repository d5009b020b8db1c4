"""Likelihoods and tail probabilities as columns."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_likelihood(s: Column, n: Column) -> Column:
    """Binomial log likelihood of s of n at its own rate, without the constant; 0 * ln 0 is 0."""
    hit = F.when(s > 0, s * F.ln(s / n)).otherwise(0.0)
    miss = F.when(n - s > 0, (n - s) * F.ln((n - s) / n)).otherwise(0.0)
    return hit + miss


def f_tail_one(f: Column, df: Column) -> Column:
    """Upper tail of the F distribution with 1 and df (whole) degrees: Student's t as a finite series."""
    theta = F.atan(F.sqrt(f / df))
    sin, cos2 = F.sin(theta), F.pow(F.cos(theta), F.lit(2))
    odd = df % 2 == 1
    terms = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    start = F.struct(F.when(odd, F.cos(theta)).otherwise(F.lit(1.0)).alias("term"), F.lit(0.0).alias("sum"))

    def step(acc, k):
        ratio = F.when(odd, (2 * k) / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        return F.struct((acc["term"] * cos2 * ratio).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

    series = F.when(terms > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, step, lambda a: a["sum"])).otherwise(0.0)
    area = F.when(odd, F.lit(2 / math.pi) * (theta + sin * series)).otherwise(sin * series)
    return F.greatest(F.lit(0.0), 1 - area)


def f_tail_two(f: Column, df: Column) -> Column:
    """Upper tail of the F distribution with 2 and df degrees."""
    return F.pow(1 + 2 * f / df, -df / 2)


def chi2_tail_two(g: Column) -> Column:
    return F.exp(-g / 2)


def _lgamma(x: np.ndarray) -> np.ndarray:
    some, own = np.unique(x, return_inverse=True)  # degrees: few different ones
    return np.array([math.lgamma(v) for v in some])[own].reshape(x.shape)


def erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function of numbers from 0: a series below 2, a continued fraction above."""
    small = np.minimum(x, 2.0)
    term = total = 2 / math.sqrt(math.pi) * small * np.exp(-small * small)
    for n in range(1, 60):
        term = term * 2 * small * small / (2 * n + 1)
        total = total + term
    large = np.maximum(x, 2.0)
    part = np.ones_like(large)
    for n in range(80, 0, -1):
        part = 1 + n / (2 * large * large) / part
    return np.where(x < 2, 1 - total, np.exp(-large * large) / (large * math.sqrt(math.pi) * part))


@F.pandas_udf(T.DoubleType())
def chi2_tail_one(g: pd.Series) -> pd.Series:
    """Upper tail of chi square with one degree, by the complementary error function."""
    x = np.sqrt(np.maximum(g.to_numpy(np.float64), 0.0) / 2)
    return pd.Series(erfc(np.nan_to_num(x))).where(g.notna().to_numpy())


def _fraction(first, step, rounds: int = 500):
    """A continued fraction b0 + a1/(b1 + a2/(b2 + ...)) on arrays, by the modified Lentz method; step(n): a, b."""
    tiny = 1e-300
    f = np.where(first == 0, tiny, first)
    c, d = f, np.zeros_like(f)
    for n in range(1, rounds):
        a, b = step(n)
        d = b + a * d
        d = 1 / np.where(d == 0, tiny, d)
        c = b + a / c
        c = np.where(c == 0, tiny, c)
        f = f * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return f


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of arrays, x strictly inside (0, 1) or at its ends."""
    swap = x >= (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (y > 0) & (y < 1)
    y = np.where(inside, y, 0.5)

    def step(n):
        m = n // 2
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        return (even if n % 2 == 0 else odd), np.ones_like(y)

    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y))
    got = np.where(inside, front / p / _fraction(np.ones_like(y), step), 0.0)
    return np.where(swap, 1 - got, got)


def _floats(*series):
    found = [s.to_numpy(np.float64) for s in series]
    return np.logical_and.reduce([np.isfinite(s) for s in found]), found


@F.pandas_udf(T.DoubleType())
def f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution with any degrees; null for degrees that are not positive."""
    fine, (x, p, q) = _floats(f, df1, df2)
    fine &= (q > 0) & (p > 0)
    x, p, q = (np.where(fine, v, 1.0) for v in (x, p, q))
    return pd.Series(np.where(x <= 0, 1.0, incomplete_beta(q / 2, p / 2, q / (q + p * np.maximum(x, 0))))).where(fine)


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised upper incomplete gamma function of arrays: a series for small x, else a continued fraction."""
    low = x < a + 1
    y = np.where(low, np.maximum(x, 1e-300), 1.0)
    term = total = 1 / a
    for n in range(1, 2000):
        term = term * y / (a + n)
        total = total + term
        if np.all(term <= total * 1e-17):
            break
    series = 1 - np.exp(-y + a * np.log(y) - _lgamma(a)) * total
    z = np.where(low, a + 2, x)
    front = np.exp(-z + a * np.log(z) - _lgamma(a))
    return np.where(x <= 0, 1.0, np.where(low, series, front / _fraction(z + 1 - a, lambda n: (-n * (n - a), z + 2 * n + 1 - a))))


@F.pandas_udf(T.DoubleType())
def chi2_tail(g: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of chi square with any degrees; null for degrees that are not positive."""
    fine, (x, k) = _floats(g, df)
    fine &= k > 0
    return pd.Series(gamma_upper(np.where(fine, k, 1.0) / 2, np.where(fine, x, 1.0) / 2)).where(fine)
