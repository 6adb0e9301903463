"""Chunked series operations equal the plain windows, and quantiles equal numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline.plans.quantiles import bracketed_quantiles, quantiles
from emberline.plans.series import Series


def frame(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    # One key holds two thirds of the rows; positions repeat and cluster.
    pdf = pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.66, 0, rng.integers(1, 5, n)),
            "p": np.floor(rng.exponential(40, n)).astype("int64"),
            "i": np.arange(n),
            "v": rng.integers(0, 9, n).astype(float),
        }
    )
    return spark.createDataFrame(pdf).withColumn("v", F.when(F.col("v") > 2, F.col("v")))


def run(df, max_rows):
    s = Series(df, ["k"], ["p", "i"], F.col("p").cast("double"), max_rows)
    s.shift({"lag1": (F.col("v"), 1), "lag3": (F.col("i"), 3), "lead2": (F.col("i"), -2), "lead1": (F.col("v"), -1)})
    s.cumsum({"cs": F.coalesce("v", F.lit(0.0))}).row_number().total({"n": F.lit(1)})
    s.last_seen({"ls": F.col("v")}).next_seen({"ns": F.col("v")})
    return s.chunked, s.done().select("k", "p", "i", "v", "lag1", "lag3", "lead2", "lead1", "cs", "rn", "n", "ls", "ns").orderBy("i").collect()


@pytest.mark.parametrize("limit", [4, 25])
def test_chunked_equals_plain(spark, limit):
    df = frame(spark)
    hot, got = run(df, limit)
    cold, want = run(df, 10**6)
    assert hot and not cold
    assert got == want


def test_null_keys_null_sums_bursts_and_ties(spark):
    """Null keys and values, most rows at one instant, and rows that no position tells apart."""
    rows = [(None if i % 3 else 0, 5 if i < 200 else i, i, None if i % 7 else float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, p long, i long, v double")

    def walk(limit):
        s = Series(df, ["k"], ["p", "i"], F.col("p").cast("double"), limit)
        s.shift({"a": (F.col("v"), 1), "b": (F.col("i"), -3)}).cumsum({"cs": F.col("v")}).row_number().total({"n": F.lit(1), "t": F.col("v")})
        s.last_seen({"ls": F.col("v")}).next_seen({"ns": F.col("v")})
        return s.chunked, s.done().select("k", "p", "i", "v", "a", "b", "cs", "rn", "n", "t", "ls", "ns").orderBy("i").collect()

    hot, got = walk(10)
    cold, want = walk(10**6)
    assert hot and not cold and got == want


def test_a_burst_is_cut_into_even_chunks(spark):
    rows = [(0, i if i < 10 else 10**6 + i, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, p long, i long")
    s = Series(df, ["k"], ["p", "i"], F.col("p").cast("double"), 100)
    assert max(r["count"] for r in s.df.groupBy("_chunk").count().collect()) <= 100


def test_quantiles_skip_nan_and_null(spark):
    df = spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, 3.0), (1, None), (2, float("nan"))], "g long, v double")
    got = {r.g: r for r in quantiles(df, ["g"], F.col("v"), {"q": 0.5}).collect()}
    assert got[1].q == 2.0 and got[2].q is None
    assert quantiles(df.limit(0), [], F.col("v"), {"q": 0.5}).first().q is None


def test_bracketed_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 60000) * (rng.random(60000) < 0.3), "v": np.round(rng.lognormal(2, 1, 60000), 3)})
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0}
    got = bracketed_quantiles(spark.createDataFrame(pdf), ["g"], F.col("v"), probs).collect()
    for r in got:
        v = pdf.loc[pdf.g == r.g, "v"]
        assert np.allclose([r[k] for k in probs], np.percentile(v, [100 * p for p in probs.values()]))
