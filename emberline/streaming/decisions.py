"""Peak decisions on a stream of thermostat states.

A decision carries no state from one reading to the next, so each micro-batch is decided like a table. Each
batch writes its own partition and a replayed batch overwrites it, so a restart leaves one copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.operators.decide import check_windows, peak_decision


def stream_peak_decision(
    states: DataFrame,
    windows: DataFrame,
    forecast: DataFrame | None,
    config: dict[str, float],
    score: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    check_windows(windows)

    def decide(batch: DataFrame, batch_id: int) -> None:
        out = peak_decision(batch, windows, forecast, config, score, validate=False)
        out.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "batch"
        ).parquet(path)

    return states.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
