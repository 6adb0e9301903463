"""HVAC-off drift: slopes, off-time, greedy anchored segments, first passage of the comfort boundary.

Segments never cross a month. Within one, rows fall into islands (no gap, no missing reading, equipment
off). Inside an island only two things can end a segment or start the next one: a change of the setpoint
pair and the first row with enough temperature difference. So an island is reduced, by a map-side combined
aggregate, to its runs of constant setpoints, and only those runs pass through the greedy anchor walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalar import drift_direction, episode_id, equipment_running
from emberline.plans.series import Series, telemetry_series
from emberline.plans.staging import stage
from emberline.schema import MEASURES, RUNTIME_COLUMNS
from emberline.session import ship_package

# Thresholds of the segmentation.
MIN_DELTA_F = 3.0
MAX_SETPOINT_CHANGE_F = 1.0
MAX_GAP_MIN = 10.0
STEP_MIN = 5
MIN_TIME_TO_BOUNDARY_MIN = 15


def minutes_between(start, end) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(60000000.0)


def available_equipment(t: DataFrame, columns: list[str] = RUNTIME_COLUMNS) -> DataFrame:
    """Per home and month: which run-time columns ever exceed zero. Homes with none are absent."""
    used = t.groupBy("home_id", "month").agg(*[F.coalesce(F.max(c) > 0, F.lit(False)).alias(f"has_{c}") for c in columns])
    any_used = F.lit(False)
    for c in columns:
        any_used = any_used | F.col(f"has_{c}")
    return used.where(any_used)


def with_equipment(t: DataFrame, columns: list[str] = RUNTIME_COLUMNS) -> DataFrame:
    """Rows of home-months that have equipment. A column never above zero cannot read as running anyway."""
    return t.join(available_equipment(t, columns).select("home_id", "month"), ["home_id", "month"], "left_semi")


def add_gap(s: Series) -> Series:
    s.shift({"prev_ts": (F.col("ts"), 1)})
    return s.with_columns({"gap_min": minutes_between("prev_ts", "ts")})


def add_recent_slopes(s: Series, columns: list[str], steps: list[int], max_gap: float) -> Series:
    """Degrees per hour over the last n rows; NULL if one of the n+1 values is missing or a gap is too long.

    Needs ``rn`` and ``gap_min``. The window test uses the position of the latest bad row, so the cost
    does not grow with n.
    """
    s.last_seen(
        {
            "_bad_gap": F.when(F.col("gap_min") > max_gap, F.col("rn")),
            **{f"_bad_{c}": F.when(F.col(c).isNull(), F.col("rn")) for c in columns},
        }
    )
    s.shift(
        {
            **{f"_t{n}": (F.col("ts"), n) for n in steps},
            **{f"_v{n}_{c}": (F.col(c), n) for n in steps for c in columns},
        }
    )
    zero = F.lit(0)
    out = {}
    for n in steps:
        hours = minutes_between(f"_t{n}", "ts") / 60.0
        for c in columns:
            whole = (
                (F.col("rn") > n)
                & (F.coalesce("_bad_gap", zero) <= F.col("rn") - n)
                & (F.coalesce(f"_bad_{c}", zero) < F.col("rn") - n)
                & (hours > 0)
            )
            out[f"{c}_slope_{n}"] = F.when(whole, (F.col(c) - F.col(f"_v{n}_{c}")) / hours)
    s.with_columns(out)
    s.df = s.df.drop("_bad_gap", *[f"_bad_{c}" for c in columns], *[f"_t{n}" for n in steps], *[f"_v{n}_{c}" for n in steps for c in columns])
    return s


def add_time_since_off(s: Series, max_gap: float, columns: list[str] = RUNTIME_COLUMNS) -> Series:
    """Minutes back to where the valid, gap-free, equipment-off stretch before this row began.

    Needs ``rn`` and ``gap_min``. Adds ``off``, ``breaks`` (the stretch cannot reach past this row) and
    ``off_min``.
    """
    s.with_columns({"off": F.col("indoor").isNotNull() & F.col("outdoor").isNotNull() & ~equipment_running(columns)})
    s.shift({"_prev_off": (F.col("off"), 1)})
    s.with_columns({"breaks": (F.col("rn") == 1) | (F.col("gap_min") > max_gap) | ~F.coalesce("_prev_off", F.lit(False))})
    s.last_seen({"_from": F.when(F.col("breaks"), F.col("ts"))})
    s.with_columns({"off_min": minutes_between("_from", "ts")})
    s.df = s.df.drop("_prev_off", "_from")
    return s


def recent_slope(t: DataFrame, columns=("indoor", "outdoor"), steps=(3, 6), max_gap: float = MAX_GAP_MIN) -> DataFrame:
    s = telemetry_series(t, by_month=True).row_number()
    return add_recent_slopes(add_gap(s), list(columns), list(steps), max_gap).done()


def time_since_off(t: DataFrame, max_gap: float = MAX_GAP_MIN) -> DataFrame:
    s = telemetry_series(t, by_month=True).row_number()
    return add_time_since_off(add_gap(s), max_gap).done()


START = ["start_ts", "start_temp", "start_outdoor", "start_heat", "start_cool", "slope_in_3", "slope_in_6", "slope_out_3", "slope_out_6", "off_min"]
START_SCHEMA = (
    "island long, run long, seg_rn long, start_ts timestamp, start_temp double, start_outdoor double,"
    " start_heat double, start_cool double, slope_in_3 double, slope_in_6 double, slope_out_3 double, slope_out_6 double, off_min double"
)


def carried(t: DataFrame) -> list[str]:
    """Columns that segments take along as they are: event ids, states, splits, whatever the table has besides the readings."""
    return [c for c in t.columns if c not in ("home_id", "month", "ts", *MEASURES)]


def _anchor_walk(max_change: float):
    """Greedy anchoring over runs sorted by (home, month, island, run); state is one anchor, whatever the size."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island, current = None, None
        for pdf in batches:
            keys = list(zip(pdf["home_id"], pdf["month"], pdf["island"]))
            heat, cool = pdf["heat"].to_numpy(), pdf["cool"].to_numpy()
            starts = list(pdf[["elig_rn", *START]].itertuples(index=False, name=None))
            eligible = pdf["elig_rn"].notna().to_numpy()
            rows, picks = [], []
            for i, key in enumerate(keys):
                if key != island:
                    island, current = key, None
                if current is not None and (
                    abs(heat[i] - current[4]) > max_change or abs(cool[i] - current[5]) > max_change
                ):
                    current = None
                if current is None and eligible[i]:
                    current = starts[i]
                if current is not None:
                    rows.append(i)
                    picks.append(current)
            out = pdf.iloc[rows][["home_id", "month", "island", "run"]].reset_index(drop=True)
            got = pd.DataFrame(picks, columns=["seg_rn", *START])
            got["seg_rn"] = got["seg_rn"].astype("int64")
            got["start_ts"] = got["start_ts"].astype("datetime64[ns]")
            for c in START[1:]:
                got[c] = got[c].astype("float64")
            yield pd.concat([out, got], axis=1)

    return walk


def drift_segments(
    t: DataFrame,
    min_delta: float = MIN_DELTA_F,
    max_change: float = MAX_SETPOINT_CHANGE_F,
    max_gap: float = MAX_GAP_MIN,
    columns: list[str] = RUNTIME_COLUMNS,
) -> DataFrame:
    """Every row that belongs to a candidate segment, with its index in it and the start row's attributes.

    Home ids keep their type and other columns pass through. The table is read once: whether a home-month has equipment
    is a sum in the partitioning all steps share, and the off rows are written before runs and segments read them.
    """
    used = F.lit(False)
    for c in columns:
        used = used | F.coalesce(F.col(c) > 0, F.lit(False))
    s = telemetry_series(t, by_month=True).row_number().total({"_used": used.cast("long")}).where(F.col("_used") > 0)
    add_gap(s)
    add_recent_slopes(s, ["indoor", "outdoor"], [3, 6], max_gap)
    add_time_since_off(s, max_gap, columns)
    s.with_columns({"heat0": F.coalesce("heat_sp", F.lit(0.0)), "cool0": F.coalesce("cool_sp", F.lit(0.0))})
    s.shift({"_h": (F.col("heat0"), 1), "_c": (F.col("cool0"), 1)})
    moved = F.col("breaks") | (F.col("heat0") != F.col("_h")) | (F.col("cool0") != F.col("_c"))
    s.cumsum(
        {
            "island": (F.col("off") & F.col("breaks")).cast("long"),
            "run": (F.col("off") & moved).cast("long"),
        }
    )
    rows = stage(s.done().where("off").drop("_h", "_c", "_used", "prev_ts", "gap_min", "breaks", "off"), "drift-rows")
    elig = F.abs(F.col("indoor") - F.col("outdoor")) >= min_delta
    first = F.struct(
        F.col("rn").alias("elig_rn"),
        F.col("ts").alias("start_ts"),
        F.col("indoor").alias("start_temp"),
        F.col("outdoor").alias("start_outdoor"),
        F.col("heat0").alias("start_heat"),
        F.col("cool0").alias("start_cool"),
        F.col("indoor_slope_3").alias("slope_in_3"),
        F.col("indoor_slope_6").alias("slope_in_6"),
        F.col("outdoor_slope_3").alias("slope_out_3"),
        F.col("outdoor_slope_6").alias("slope_out_6"),
        F.col("off_min"),
    )
    ship_package(t.sparkSession)
    runs = rows.groupBy("home_id", "month", "island", "run").agg(
        F.min("heat0").alias("heat"), F.min("cool0").alias("cool"), F.min_by(first, F.when(elig, F.col("rn"))).alias("f")
    )
    walked = (
        runs.select("home_id", "month", "island", "run", "heat", "cool", "f.*")
        .repartition("home_id", "month", "island")
        .sortWithinPartitions("home_id", "month", "island", "run")
        .mapInPandas(_anchor_walk(max_change), f"home_id {t.schema['home_id'].dataType.simpleString()}, month {t.schema['month'].dataType.simpleString()}, {START_SCHEMA}")
    )
    keep = ["home_id", "month", "island", "run", "rn", "ts", *carried(t), *MEASURES]
    joined = rows.select(*keep).join(walked, ["home_id", "month", "island", "run"])
    return joined.where(F.col("rn") >= F.col("seg_rn")).withColumn("timestep_idx", (F.col("rn") - F.col("seg_rn")).cast("long"))


BOUNDARY = ["drift_direction", "target_boundary", "boundary_temp", "signed_boundary_gap", "distance_to_boundary"]


def with_boundary(segments: DataFrame) -> DataFrame:
    """Adds the boundary the start row drifts to, whether it can be drifted to, and which rows are past it."""
    d = drift_direction("start_temp", "start_outdoor", "start_heat", "start_cool")
    rows = segments.withColumn("_d", d).select("*", "_d.*").drop("_d")
    cooling = F.col("drift_direction") == "cooling_drift"
    past = F.when(cooling, F.col("indoor") >= F.col("boundary_temp")).otherwise(F.col("indoor") <= F.col("boundary_temp"))
    return rows.withColumns(
        {
            "eligible": (F.col("boundary_temp") != 0) & (F.col("distance_to_boundary") > 0),
            "_cross_at": F.when(past, F.col("timestep_idx")),
        }
    )


def first_passage(segments: DataFrame, step_min: int = STEP_MIN) -> DataFrame:
    """One row per candidate segment: length, boundary, first crossing index (NULL if never) and label."""
    seg = with_boundary(segments).groupBy("home_id", "month", "seg_rn").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("_cross_at").alias("crossing_timestep_idx"),
        *[F.first(a, ignorenulls=True).alias(a) for a in [*START, *BOUNDARY, "eligible"]],
    )
    return seg.withColumn("time_to_boundary_min", F.when(F.col("eligible"), F.col("crossing_timestep_idx") * step_min))


def extraction_funnel(passages: DataFrame, min_minutes: float = MIN_TIME_TO_BOUNDARY_MIN) -> DataFrame:
    ok = F.col("eligible")
    crossed = ok & (F.coalesce("time_to_boundary_min", F.lit(-1)) >= min_minutes)
    n = lambda c: F.count(F.when(c, 1))
    return passages.agg(
        F.count(F.lit(1)).alias("candidate_intervals"),
        n(crossed).alias("crossed_intervals"),
        n(ok & F.col("crossing_timestep_idx").isNull()).alias("dropped_no_crossing"),
        (n(crossed) / F.count(F.lit(1))).alias("crossed_fraction"),
    )


def drift_episodes(
    t: DataFrame,
    min_minutes: float = MIN_TIME_TO_BOUNDARY_MIN,
    step_min: int = STEP_MIN,
    max_gap: float = MAX_GAP_MIN,
    min_delta: float = MIN_DELTA_F,
    max_change: float = MAX_SETPOINT_CHANGE_F,
) -> DataFrame:
    """Step table of kept segments, start row to crossing row, in the episode schema."""
    segs = with_boundary(drift_segments(t, min_delta, max_change, max_gap)).where("eligible")
    # A window keeps the rows beside their segment's crossing: joining an aggregate back would run the
    # segmentation twice. The window spills, and its key is one segment, not one home.
    seg = Window.partitionBy("home_id", "month", "seg_rn")
    crossed = segs.withColumn("crossing_timestep_idx", F.min("_cross_at").over(seg))
    label = F.col("crossing_timestep_idx") * step_min
    steps = crossed.withColumn("time_to_boundary_min", label).where(
        (label >= min_minutes) & (F.col("timestep_idx") <= F.col("crossing_timestep_idx"))
    )
    return steps.select(
        "home_id",
        episode_id("home_id", F.lit("drift"), "start_ts").alias("episode_id"),
        F.col("ts").alias("timestamp"),
        *carried(t),
        "timestep_idx",
        "drift_direction",
        "start_temp",
        "start_outdoor",
        (F.col("start_temp") - F.col("start_outdoor")).alias("initial_delta"),
        "target_boundary",
        "boundary_temp",
        F.lit(True).alias("crossed_boundary"),
        "crossing_timestep_idx",
        "time_to_boundary_min",
        "distance_to_boundary",
        "signed_boundary_gap",
        F.col("slope_in_3").alias("recent_indoor_slope_15m"),
        F.col("slope_in_6").alias("recent_indoor_slope_30m"),
        F.col("slope_out_3").alias("recent_outdoor_slope_15m"),
        F.col("slope_out_6").alias("recent_outdoor_slope_30m"),
        F.col("off_min").alias("time_since_hvac_off_min"),
        "indoor",
        "outdoor",
        "heat_sp",
        "cool_sp",
        "humidity",
    )
