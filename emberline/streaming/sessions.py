"""Heating and cooling runs over a stream of readings.

Each home keeps the readings that the watermark has not passed yet and its open run. Once the watermark passes a
reading no earlier one can follow, so readings join runs in the order of time, however they arrived. A run ends with a reading
of another mode, with a gap, or, when no reading follows, by a timer in event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from emberline.functions.scalar import comfort_mode, setpoint_gap
from emberline.session import ship_package

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUN = "run long, mode string, start_us long, last_us long, steps long, max_gap double, sum_gap double"
READING = "us long, tie long, mode string, gap double"
ACTIVE = ("heating", "cooling")


class ModeRuns(StatefulProcessor):
    """State of one home: waiting readings, and the open run."""

    def __init__(self, max_gap_min: float, home: T.StructField):
        self.max_gap_us, self.home = int(max_gap_min * 60_000_000), home

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", READING)
        self.open = handle.getValueState("open", RUN)

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            readings = list(part[["us", "tie", "mode", "gap"]].itertuples(index=False, name=None))
            self.waiting.appendList([(int(us), int(tie), mode, float(gap)) for us, tie, mode, gap in readings])
            first = min([r[0] for r in readings] + ([first] if first is not None else []))
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        run = tuple(self.open.get()) if self.open.exists() else None
        done, number = [], run[0] if run else 0
        at = 0
        while at < len(waiting) and waiting[at][0] <= passed:
            us, _, mode, gap = waiting[at]
            at += 1
            if run and run[1] == mode and us - run[3] <= self.max_gap_us:
                run = (run[0], mode, run[2], us, run[4] + 1, max(run[5], gap), run[6] + gap)
                continue
            done += [run] if run else []
            number += 1
            run = (number, mode, us, us, 1, gap, gap)
        if run and run[1] is not None and run[3] + self.max_gap_us < passed:
            done.append(run)
            run = (run[0], None, run[3], run[3], 0, 0.0, 0.0)  # only the number goes on
        self.waiting.put(waiting[at:]) if at < len(waiting) else self.waiting.clear()
        if run:
            self.open.update(run)
        later = [waiting[at][0]] if at < len(waiting) else []
        later += [run[3] + self.max_gap_us] if run and run[1] is not None else []
        if later:
            self._wake(max(min(later), passed))
        out = [r for r in done if r[1] in ACTIVE]
        if out:
            yield pd.DataFrame(
                {
                    "home_id": pd.Series([key[0]] * len(out)),
                    "run": [r[0] for r in out],
                    "mode": [r[1] for r in out],
                    "start_ts": pd.to_datetime([r[2] for r in out], unit="us"),
                    "duration_steps": [r[4] for r in out],
                    "max_gap": [r[5] for r in out],
                    "mean_gap": [r[6] / r[4] for r in out],
                }
            )

    def close(self) -> None:
        pass


def mode_sessions(t: DataFrame, max_gap_min: float, delay: str) -> DataFrame:
    """The runs of a streaming telemetry table (home_id, ts, indoor, heat_sp, cool_sp and, to order equal instants, event_id where there is one).

    A run closes with a reading of another mode (an invalid one included), one more than ``max_gap_min`` after the last, or
    once the watermark, ``delay`` behind the latest reading of all homes, is that far past the last. Readings behind the watermark are late and dropped by Spark.
    A null home is a home; rows of null time have no place in a series and are left out. ``run`` counts the runs of all modes of a home, as ``mode_episodes`` does.
    """
    spark = t.sparkSession
    ship_package(spark)
    spark.conf.set(PROVIDER, ROCKSDB)
    tie = F.col("event_id").cast("long") if "event_id" in t.columns else F.lit(0).cast("long")
    rows = t.where(F.col("ts").isNotNull()).withWatermark("ts", delay)
    rows = rows.select("home_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce(tie, F.lit(-1)).alias("tie"), comfort_mode().alias("mode"), setpoint_gap().cast("double").alias("gap"))
    home = t.schema["home_id"]
    schema = T.StructType([home, *T._parse_datatype_string("run long, mode string, start_ts timestamp, duration_steps long, max_gap double, mean_gap double").fields])
    return rows.groupBy("home_id").transformWithStateInPandas(ModeRuns(max_gap_min, home), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def stream_mode_sessions(t: DataFrame, path: str, checkpoint: str, max_gap_min: float = 10.0, delay: str = "1 hour", trigger: dict | None = None) -> StreamingQuery:
    """Append closed runs to parquet files; a restart from ``checkpoint`` goes on where the stream stopped, with state and timers."""
    out = mode_sessions(t, max_gap_min, delay).writeStream.outputMode("append").format("parquet").option("path", path)
    return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
