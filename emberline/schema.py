"""Column contracts. No reader in this package infers a schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RUNTIME_COLUMNS = ["heat_run", "cool_run"]
MEASURES = ["indoor", "outdoor", "heat_sp", "cool_sp", "humidity", "heat_run", "cool_run"]

TELEMETRY = T.StructType(
    [
        T.StructField("home_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("month", T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in MEASURES],
    ]
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail while the plan is built, naming every absent column in sorted order."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
