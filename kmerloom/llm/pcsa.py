"""Distinct counts with mergeable bit-matrix sketches and maximum likelihood (problem 3).

A value's hash picks one of ``m`` rows and, by the trailing zeros of the other bits, a rank; the sketch is
the m x 40 matrix of the ranks seen. It is stored sparsely, one table row (group, row, bits) for each
matrix row with a bit set, so that a small group has a small sketch. Sketches of any two sets merge by the
bitwise union of their bits. With n distinct values bit (row, rank) is set with probability
1 - exp(-n 2^-(rank+1) / m); n is estimated by maximum likelihood from the number of rows set at each
rank, and its standard error comes from the Fisher information (about 0.65 / sqrt(m) of n when n >> m).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.session import require_columns

ROWS = 1024
RANKS = 40


def _row(value: Column, m: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(m)).cast("int")


def _bits(value: Column) -> Column:
    """A word with the one bit of the value's rank: the lowest bit set of a second hash."""
    h = F.xxhash64(F.lit(1), value).bitwiseOR(F.lit(1 << (RANKS - 1)))
    return h.bitwiseAND(-h)


def sketch(df: DataFrame, by: Sequence[str], value: str, m: int = ROWS) -> DataFrame:
    """by..., row, bits, n: the sketch of the distinct values of every group, and its rows of df with a value.

    Null values are not counted; nulls in ``by`` are groups of their own. Partial sketches are united in
    hash maps before the shuffle, so that a hot group or value sends m rows a task at most.
    """
    if m & (m - 1) or m < 16:
        raise ValueError("m must be a power of two, 16 at least")
    require_columns(df, [*by, value])
    v = F.col(value)
    rows = df.where(v.isNotNull()).select(*by, _row(v, m).alias("row"), _bits(v).alias("bits"))
    return rows.groupBy(*by, "row").agg(F.bit_or("bits").alias("bits"), F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Union of sketches: to coarser groups, or of sketches of several loads put together by unionByName."""
    return sketches.groupBy(*by, "row").agg(F.bit_or("bits").alias("bits"), F.sum("n").cast("bigint").alias("n"))


def likelihood_estimate(set_rows: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and standard errors from the rows set at each rank; one line of set_rows for each sketch."""
    s = np.asarray(set_rows, float).reshape(-1, RANKS)
    rank = np.arange(RANKS)
    q = np.ldexp(1.0, -(rank + 1)) / m
    q[-1] = np.ldexp(1.0, -(RANKS - 1)) / m  # the last rank holds all that is left
    lo, hi = np.full(len(s), -1.0), np.full(len(s), 62.0)  # log2 of n

    def score(n: np.ndarray) -> np.ndarray:
        x = np.minimum(n[:, None] * q, 700)
        return (q * (s * np.exp(-x) / -np.expm1(-x) - (m - s))).sum(1)

    for _ in range(60):
        mid = (lo + hi) / 2
        up = score(np.exp2(mid)) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    n = np.exp2((lo + hi) / 2)
    x = np.minimum(n[:, None] * q, 700)
    info = (m * q * q * np.exp(-x) / np.maximum(-np.expm1(-x), 1e-300)).sum(1)
    # the rows taken are a multinomial split, not Poisson: its own share of the variance is n
    se = np.sqrt(np.maximum(1 / info - n, 0.0) + 1e-12)
    empty = s.sum(1) == 0
    return np.where(empty, 0.0, n), np.where(empty, 0.0, se)


def estimate(sketches: DataFrame, by: Sequence[str], m: int = ROWS) -> DataFrame:
    """by..., n, estimate, std_error of every group of sketches; n is the number of rows sketched."""
    counts = [F.sum(F.getbit("bits", F.lit(r)).cast("int")).cast("int").alias(f"s{r}") for r in range(RANKS)]
    grouped = sketches.groupBy(*by).agg(F.sum("n").cast("bigint").alias("n"), *counts)

    @F.pandas_udf("estimate double, std_error double")
    def solve(rows: pd.Series) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"estimate": np.zeros(0), "std_error": np.zeros(0)})
        lines, line = np.unique(np.stack(rows.to_numpy()), axis=0, return_inverse=True)  # small groups are often alike
        est, se = likelihood_estimate(lines, m)
        return pd.DataFrame({"estimate": est[line], "std_error": se[line]})

    out = grouped.select(*by, "n", solve(F.array(*[f"s{r}" for r in range(RANKS)])).alias("e"))
    return out.select(*by, "n", F.col("e.estimate").alias("estimate"), F.col("e.std_error").alias("std_error"))
