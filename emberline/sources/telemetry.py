"""Readers and dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.schema import TELEMETRY, require_columns


def grid_to_long(grid: DataFrame, measures: list[str]) -> DataFrame:
    """Parallel arrays to one row per sample. A generator: no shuffle, and one grid row is one month."""
    rows = F.inline(F.arrays_zip(F.col("times").alias("ts"), *[F.col(m) for m in measures]))
    return grid.select("home_id", "month", rows).toDF("home_id", "month", "ts", *measures)


def home_state_dim(t: DataFrame, value: str = "state") -> DataFrame:
    """The attribute at a home's first time step; empty text is dropped."""
    first = t.groupBy("home_id").agg(F.min_by(value, F.struct(*[c for c in ("ts", "event_id") if c in t.columns])).alias(value))
    return first.where(F.col(value) != "")


def read_telemetry_csv(spark: SparkSession, path: str, schema: T.StructType = TELEMETRY) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS", nanValue="NaN")


def home_splits(t: DataFrame) -> DataFrame:
    """One split per home. A map-side combined distinct on two columns; order does not matter."""
    return t.groupBy("home_id").agg(F.min("split").alias("split"))


def scan_episode_starts(spark: SparkSession, path: str, schema: T.StructType, lo: float, hi: float, columns: list[str]) -> DataFrame:
    """First steps of crossed episodes with a duration in [lo, hi]; filters and columns reach the scan."""
    e = spark.read.schema(schema).parquet(path)
    keep = (F.col("timestep_idx") == 0) & F.col("crossed_boundary") & F.col("time_to_boundary_min").between(lo, hi)
    return e.where(keep).select(*columns)


def scan_episodes(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> DataFrame:
    return require_columns(spark.read.schema(schema).parquet(path), required)


def filter_dim(dim: DataFrame, **equals) -> DataFrame:
    """Rows whose attributes equal all given values; an unknown attribute is an error."""
    unknown = sorted(set(equals) - set(dim.columns))
    if unknown:
        raise ValueError(f"unknown attributes {unknown}; known: {sorted(dim.columns)}")
    out = dim
    for k, v in equals.items():
        out = out.where(F.col(k) == F.lit(v))
    return out


def attach_dim(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join to a one-row-per-key table; the planner broadcasts it while it is small."""
    return df.join(dim, key, "left")


def semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def between(column: str, lo: float, hi: float) -> Column:
    return F.col(column).between(lo, hi)
