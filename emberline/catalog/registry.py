"""Named queries over the check tables, each with the same question in plain SQL where that is feasible."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.catalog.sqltext import compose

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six places, minus zero to zero: both engines then agree on the last digit."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(sql: str | None = None, rnd: str = ""):
    """Register a query under its function name; ``rnd`` lists the SQL columns to round."""

    def add(fn: Query) -> Query:
        name = fn.__name__
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = compose(sql, rnd.split())
        return fn

    return add
