"""Least squares from grouped sums: one map-side combined aggregate, then a tiny solve per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.session import ship_package


def gram(df: DataFrame, keys: list[str], xs: list[str], y: str) -> DataFrame:
    """n, sums and cross-products of [xs, y] per group. All partial sums combine before the shuffle."""
    cols = [*xs, y]
    sums = [F.sum(F.col(c)).alias(f"_s{i}") for i, c in enumerate(cols)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    prods = [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"_p{i}_{j}") for i, j in pairs]
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *prods)
    return agg.select(
        *keys,
        "n",
        F.array(*[F.col(f"_s{i}") for i in range(len(cols))]).alias("s"),
        F.array(*[F.col(f"_p{i}_{j}") for i, j in pairs]).alias("p"),
    )


def unpack(n: float, s: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and centred cross-product matrix from a gram row."""
    k = len(s)
    full = np.zeros((k, k))
    full[np.triu_indices(k)] = p
    full = full + np.triu(full, 1).T
    mean = np.asarray(s) / n
    return mean, full - n * np.outer(mean, mean)


def ridge_coefficients(n: float, s: np.ndarray, p: np.ndarray, alpha: float, standardize: bool) -> np.ndarray:
    """[intercept, slopes...]; ``alpha`` penalises slopes only. Rank-deficient systems take the least-norm answer."""
    mean, c = unpack(n, s, p)
    cxx, cxy = c[:-1, :-1], c[:-1, -1]
    scale = np.sqrt(np.diag(cxx) / n) if standardize else np.ones(len(cxy))
    scale = np.where(scale > 1e-12, scale, 1.0)
    a = cxx / np.outer(scale, scale) + alpha * np.eye(len(cxy))
    slopes = np.linalg.lstsq(a, cxy / scale, rcond=1e-10)[0] / scale
    return np.concatenate([[mean[-1] - mean[:-1] @ slopes], slopes])


def solve(grams: DataFrame, alpha: float = 0.0, standardize: bool = False, min_n: int = 1) -> DataFrame:
    """Adds ``coef`` (intercept first). Groups under ``min_n`` rows are left out for the fallback to serve."""
    ship_package(grams.sparkSession)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def fit(n: pd.Series, s: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([ridge_coefficients(a, b, c, alpha, standardize) for a, b, c in zip(n, s, p)])

    kept = grams.where(F.col("n") >= min_n)
    return kept.withColumn("coef", fit(F.col("n").cast("double"), "s", "p")).drop("s", "p")


def linear_value(xs: list[str], coef: str = "coef"):
    """Intercept plus dot product, as a column expression inside codegen."""
    out = F.col(coef)[0]
    for i, x in enumerate(xs):
        out = out + F.col(coef)[i + 1] * F.col(x)
    return out
