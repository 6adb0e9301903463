"""Keyed lookups with an ordered list of fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """Each row of ``df`` next to the single row of ``one``; next to nulls if that is empty, so no row is lost."""
    return df.join(F.broadcast(one), F.lit(True), "left")


def lookup_with_fallback(
    df: DataFrame, levels: list[tuple[DataFrame, list[str]]], value: str, default: Column, out: str
) -> DataFrame:
    """First hit of ``value`` over the levels, finest first, else ``default``.

    Each level is a table with one row per key. No broadcast is forced: the per-home tables grow with
    the fleet, and the planner broadcasts them by itself while they are small.
    """
    hits = []
    for i, (table, keys) in enumerate(levels):
        hit = f"_hit{i}"
        hits.append(hit)
        side = table.select(*keys, F.col(value).alias(hit))
        df = df.join(side, keys, "left") if keys else beside(df, side)
    return df.withColumn(out, F.coalesce(*[F.col(h) for h in hits], default)).drop(*hits)
