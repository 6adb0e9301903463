"""Writers: partitioned tables, summaries and model artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_long(df: DataFrame, path: str, fmt: str = "csv", partition_by: tuple[str, ...] = ("month",)) -> str:
    """Append per-month output. Replaying a month overwrites its partition only, so a retry cannot duplicate."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    if fmt == "csv":
        w.csv(path, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    else:
        w.format(fmt).save(path)
    return path


def write_episodes(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def write_summary(df: DataFrame, path: str) -> str:
    """One small report file: a row per controller or check, not per reading."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return path


def save_artifact(spark: SparkSession, path: str, model_type: str, model, offsets: dict[str, DataFrame], meta: dict[str, float]) -> str:
    """A fitted model, its offset tables and a one-row description, side by side."""
    model.write().overwrite().save(f"{path}/model")
    for name, table in offsets.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    row = [(model_type, sorted(offsets), {k: float(v) for k, v in meta.items()})]
    spark.createDataFrame(row, "model_type string, offsets array<string>, meta map<string,double>").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/meta")
    return path


def load_artifact(spark: SparkSession, path: str, model_type: str, loader) -> tuple[object, dict[str, DataFrame], dict]:
    """Fails when the stored type differs from the expected one."""
    row = spark.read.parquet(f"{path}/meta").select("model_type", "offsets", F.col("meta")).first()
    if row.model_type != model_type:
        raise ValueError(f"expected model_type {model_type!r}, found {row.model_type!r}")
    return loader.load(f"{path}/model"), {o: spark.read.parquet(f"{path}/{o}") for o in row.offsets}, dict(row.meta)
