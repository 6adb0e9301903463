"""Lineage cuts: a parquet table in the folder every executor shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from emberline.session import shared_dir


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/emberline/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once, read many: used where several fits or scores share one input.

    A written table survives the loss of executors and is columnar, so each reader prunes it again.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
