"""Setpoint responses: from a setpoint jump until the target temperature is reached.

The scan is greedy and skips the row that ended an episode, so it is sequential. It is still cut into
independent blocks: once indoor sits at least ``tol`` inside the comfort band, or a reading is zero, no
episode can be open after that row whatever came before, and such a row cannot start one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalar import episode_id, nan_to_null
from emberline.plans.series import telemetry_series
from emberline.plans.staging import stage
from emberline.schema import MEASURES
from emberline.session import ship_package

MIN_CHANGE_F = 1.0
TARGET_TOLERANCE_F = 0.5

def _respond(tol: float):
    """State machine over rows sorted by (home, month, block, rn). State is one open episode."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, open_ep = None, None
        for pdf in batches:
            keys = list(zip(pdf["home_id"], pdf["month"], pdf["block"]))
            indoor, heat, cool = (pdf[c].to_numpy(dtype="float64") for c in ("indoor", "heat_sp", "cool_sp"))
            zero, trig = pdf["zero"].to_numpy(), pdf["trigger"].to_numpy()
            rn = pdf["rn"].to_numpy()
            rows, picks = [], []
            for i, key in enumerate(keys):
                if key != block:
                    block, open_ep = key, None
                if open_ep is None:
                    if trig[i] is None:
                        continue
                    rising = trig[i] == "heat_increase"
                    open_ep = (rn[i], rising, heat[i] if rising else cool[i])
                else:
                    rising = open_ep[1]
                    setpoint = heat[i] if rising else cool[i]
                    if zero[i] or abs(setpoint - open_ep[2]) > tol:
                        open_ep = None  # this row is consumed: it cannot start the next episode
                        continue
                reached = indoor[i] >= open_ep[2] if rising else indoor[i] <= open_ep[2]
                rows.append(i)
                picks.append((open_ep[0], int(reached)))
                if reached:
                    open_ep = None
            out = pdf.iloc[rows][["home_id", "month", "rn"]].reset_index(drop=True)
            got = pd.DataFrame(picks, columns=["start_rn", "reached"]).astype({"start_rn": "int64", "reached": "int32"})
            yield pd.concat([out, got], axis=1)

    return walk


def setpoint_responses(raw: DataFrame, min_change: float = MIN_CHANGE_F, tol: float = TARGET_TOLERANCE_F) -> DataFrame:
    """Step table of episodes that reached their target.

    Works on readings with sentinels: a zero temperature or setpoint ends an episode, while a NaN one only
    makes its comparisons false and is NULL in the result. Home ids keep their type; columns besides the readings pass through. Only places,
    readings and triggers go through the walk; its steps find their rows, written once, by place.
    """
    ship_package(raw.sparkSession)
    extra = [c for c in raw.columns if c not in ("home_id", "month", "ts", *MEASURES)]
    i, h, c = (nan_to_null(x) for x in ("indoor", "heat_sp", "cool_sp"))
    off = F.lit(False)
    s = telemetry_series(raw, by_month=True).row_number()
    s.with_columns({"zero": (F.coalesce(i, F.lit(1.0)) == 0) | (F.coalesce(h, F.lit(1.0)) == 0) | (F.coalesce(c, F.lit(1.0)) == 0)})
    s.with_columns({"sync": F.col("zero") | F.coalesce((i >= h + tol) & (i <= c - tol), off)})
    s.shift({"_ph": (h, 1), "_pc": (c, 1), "_pz": (F.col("zero"), 1), "_ps": (F.col("sync"), 1)})
    usable = ~F.col("zero") & ~F.coalesce("_pz", F.lit(True))
    rise = F.coalesce((h - F.col("_ph") > min_change) & (i < h), off)
    fall = F.coalesce((c - F.col("_pc") < -min_change) & (i > c), off)
    s.with_columns({"trigger": F.when(usable & rise, "heat_increase").when(usable & fall, "cool_decrease")})
    s.cumsum({"block": F.coalesce("_ps", F.lit(True)).cast("long")})
    s.last_seen({"_trig_at": F.when(F.col("trigger").isNotNull(), F.col("block"))})
    # Rows before the first trigger of their block cannot belong to an episode.
    live = stage(s.done().where(F.col("_trig_at") == F.col("block")).select("home_id", "month", "block", "rn", "ts", *extra, *MEASURES, "zero", "trigger"), "response-rows")
    place = ["home_id", "month", "rn"]
    types = ", ".join(f"{c} {raw.schema[c].dataType.simpleString()}" for c in ("home_id", "month"))
    walked = (
        live.select(*place, "block", "indoor", "heat_sp", "cool_sp", "zero", "trigger")
        .repartition("home_id", "month", "block")
        .sortWithinPartitions("home_id", "month", "block", "rn")
        .mapInPandas(_respond(tol), f"{types}, rn long, start_rn long, reached int")
    )
    rising = F.col("trigger") == "heat_increase"
    starts = live.where("trigger is not null").select(
        "home_id",
        "month",
        F.col("rn").alias("start_rn"),
        F.col("ts").alias("start_ts"),
        F.col("trigger").alias("kind"),
        F.when(rising, F.col("heat_sp")).otherwise(F.col("cool_sp")).alias("target_setpoint"),
        F.col("indoor").alias("start_temp"),
    )
    ep = Window.partitionBy("home_id", "month", "start_rn")
    steps = walked.withColumns({"_done": F.max("reached").over(ep), "n_steps": F.count(F.lit(1)).over(ep)}).where(F.col("_done") == 1)
    kept = steps.join(starts, ["home_id", "month", "start_rn"]).join(live.drop("block", "zero", "trigger"), place)
    return kept.select(
        "home_id",
        "month",
        F.col("ts").alias("timestamp"),
        *extra,
        episode_id("home_id", "kind", "start_ts").alias("episode_id"),
        F.col("kind").alias("change_type"),
        "target_setpoint",
        "start_temp",
        F.abs(F.col("target_setpoint") - F.col("start_temp")).alias("initial_gap"),
        (F.col("rn") - F.col("start_rn")).cast("long").alias("timestep_idx"),
        "n_steps",
        *[nan_to_null(m).alias(m) for m in MEASURES],
    )


def episode_counts(episodes: DataFrame, by: list[str]) -> DataFrame:
    """Exact distinct episodes per group: distinct first, so no group's ids meet in one task."""
    return episodes.select(*by, "episode_id").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_episodes"))


def episode_duration(episodes: DataFrame, step_min: int = 5) -> DataFrame:
    """Rows times step per episode. A response of n rows lasts n steps."""
    return episodes.groupBy("home_id", "episode_id", "change_type").agg(
        (F.count(F.lit(1)) * step_min).alias("duration_min"), F.min_by("initial_gap", "timestep_idx").alias("initial_gap")
    )
