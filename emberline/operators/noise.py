"""Forecast noise that follows its own last value, computed in parallel along a series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.plans.series import Series, epoch, null_safe_join
from emberline.plans.staging import stage

# Persistence, and the spread at the start, by hour and at most.
PHI, SIGMA_START, SIGMA_HOUR, SIGMA_MOST = 0.7, 0.5, 0.25, 4.0


def affine_scan(df: DataFrame, keys: list[str], place: str, factor: Column, shift: Column, name: str, chunk: int = 256) -> DataFrame:
    """Adds ``name``: x at each row of the recursion x = factor * x before + shift, from 0, in the order of ``place`` (1, 2, 3, ... by key).

    Each step is an affine map, and maps compose: rows are cut into chunks of ``chunk`` places, each folded by itself into values
    as if it started at 0, and one map. The chunks' maps are scanned in the same way, level by level, until one chunk is
    left, so a series of n rows takes log n / log chunk levels and no task holds more than ``chunk`` rows of it.
    Places must be gapless; null keys are keys.
    """
    rows = df.withColumns({"_f": factor.cast("double"), "_s": shift.cast("double"), "_chunk": F.floor((F.col(place) - 1) / chunk).cast("long")})
    steps = F.array_sort(F.collect_list(F.struct(F.col(place).alias("k"), F.col("_f").alias("f"), F.col("_s").alias("s"))))
    zero = F.struct(F.lit(1.0).alias("f"), F.lit(0.0).alias("x"), F.array().cast("array<struct<k:bigint,x:double,f:double>>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        x, f = r["f"] * a["x"] + r["s"], r["f"] * a["f"]
        return F.struct(f.alias("f"), x.alias("x"), F.concat(a["out"], F.array(F.struct(r["k"].cast("long").alias("k"), x.alias("x"), f.alias("f")))).alias("out"))

    folded = stage(rows.groupBy(*keys, "_chunk").agg(F.aggregate(steps, zero, step).alias("_a")), "affine-chunks")
    if folded.where("_chunk > 0").isEmpty():
        carried = folded.select(*keys, "_chunk", F.lit(0.0).alias("_before"), F.inline("_a.out"))
    else:
        maps = folded.select(*keys, (F.col("_chunk") + 1).alias("_link"), F.col("_a.f").alias("_cf"), F.col("_a.x").alias("_cx"))
        # What is reached after one chunk stands before the next.
        ends = affine_scan(maps, keys, "_link", F.col("_cf"), F.col("_cx"), "_before", chunk).select(*keys, F.col("_link").alias("_chunk"), "_before")
        values = folded.select(*keys, "_chunk", F.inline("_a.out"))
        carried = null_safe_join(values, ends, [*keys, "_chunk"]).withColumn("_before", F.coalesce("_before", F.lit(0.0)))
    found = carried.select(*keys, F.col("k").alias(place), (F.col("x") + F.col("f") * F.col("_before")).alias(name))
    return null_safe_join(df, found, [*keys, place])


def digest_uniform(*parts: Column) -> Column:
    """Uniform in (0, 1) from a digest of the parts; any SQL engine reproduces it."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))


def digest_normal(*parts: Column) -> Column:
    return F.sqrt(-2 * F.log(digest_uniform(*parts, F.lit("a")))) * F.cos(F.lit(2 * math.pi) * digest_uniform(*parts, F.lit("b")))


def forecast_noise(
    truth: DataFrame, keys: list[str], seeds: list[int], ts: str = "ts", value: str = "temp",
    phi: float = PHI, start: float = SIGMA_START, by_hour: float = SIGMA_HOUR, most: float = SIGMA_MOST, chunk: int = 256,
) -> DataFrame:
    """One noisy forecast of each series and seed: keys, ts, value, seed, ``error`` and ``forecast`` = value + error.

    The error is phi times the error before plus normal noise whose spread grows with the hours since the series' first time, up to ``most``. Noise comes from
    digests of keys, place in the series and seed. Rows of one time follow their value. A series of any length is cut into chunks (``affine_scan``). Rows of null time are left out; a null value has an error and a null forecast.
    """
    rows = truth.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("_ts"), F.col(value).alias("_value"))
    s = Series(rows, keys, ["_ts", "_value"], epoch("_ts")).row_number("_step")
    placed = stage(s.done(), "forecast-places")
    firsts = placed.groupBy(*keys).agg(F.min("_ts").alias("_first"))
    hours = (F.unix_micros("_ts") - F.unix_micros("_first")) / F.lit(3_600_000_000.0)
    spread = F.least(F.lit(start) + F.lit(by_hour) * hours, F.lit(most))
    seeded = null_safe_join(placed, firsts, keys).select("*", F.explode(F.array(*[F.lit(x) for x in seeds])).alias("seed"))
    shocks = seeded.withColumn("_shock", spread * digest_normal(*[F.col(k) for k in keys], F.col("_step"), F.col("seed"))).drop("_first")
    out = affine_scan(shocks, [*keys, "seed"], "_step", F.lit(phi), F.col("_shock"), "error", chunk)
    return out.select(*keys, F.col("_ts").alias(ts), F.col("_value").alias(value), "seed", "error", (F.col("_value") + F.col("error")).alias("forecast"))
