"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.catalog import load
from emberline.plans.staging import stage_path
from emberline.session import build_session

HEADLINE = [
    "mode_episodes",
    "describe_distribution",
    "setpoint_changes",
    "setpoint_change_counts",
    "gradient_totals",
    "setpoint_responses",
    "drift_episodes",
    "extraction_funnel",
    "horizon_samples",
    "stratified_home_split",
    "error_metrics",
    "ridge_plus_offsets",
    "asof_interpolate",
    "policy_kpis",
    "peak_decision",
]

#: The source project gives one time: setpoint responses of some 100 million readings in about five minutes on one thread.
LARGE, LARGE_ROWS = ["mode_episodes", "setpoint_responses"], 10_000_000


def large_table(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """A folder with ``events`` of some ten million readings: the table's own, again and again for other homes."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = events.count()
    copies = spark.range(max(1, LARGE_ROWS // n)).withColumnRenamed("id", "_k")
    path = stage_path(spark, "bench")
    # One side is a hundred numbers.
    more = events.crossJoin(F.broadcast(copies)).withColumns({"user_id": F.col("user_id") + F.col("_k") * 1_000_000, "event_id": F.col("event_id") + F.col("_k") * 100_000_000}).drop("_k")
    more.repartition(64).write.parquet(f"{path}/events.parquet")
    return path, n * max(1, LARGE_ROWS // n)


def timed(df: DataFrame) -> float:
    t0 = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("OFF")
    queries, _ = load()
    queries["mode_episodes"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    large: dict[str, float] = {}
    if os.environ.get("BENCH_LARGE", "0") == "1":
        path, rows = large_table(spark, sf_dir)
        for name in LARGE:
            t0 = time.time()
            timed(queries[name](spark, path))
            large[name] = round(time.time() - t0, 3)
        large["readings"] = rows
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "large": large, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
