"""As-of, interval and reference joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.plans.series import Series, epoch, null_safe_join


def asof_join(left: DataFrame, right: DataFrame, by: list[str], ts: str, value: str, out: str, mode: str = "backward", cell_min: int = 60) -> DataFrame:
    """Attach ``value`` of the reference series to every left row.

    ``backward``: latest point at or before the row. ``interpolate``: linear in time between neighbours.
    NULL where the series does not reach; null keys match each other.

    Rows and points are put in cells of ``cell_min`` minutes, which should hold few points. A cell's points are one sorted array, beside the nearest
    point before and after the cell: a table with one row per key and cell. Rows join it on key and cell and pick inside the
    row, so nothing is sorted but points, rows go through no window, and the adaptive join splits a cell that very many rows ask for, with or without
    ``by``. Of points at one instant the largest value counts.
    """
    if mode not in ("backward", "interpolate"):
        raise ValueError(f"unknown mode {mode!r}")

    def cell(c: str) -> Column:
        return F.floor(F.unix_micros(c) / F.lit(cell_min * 60_000_000))

    point = F.struct(F.unix_micros(ts).alias("t"), F.col(value).cast("double").alias("v"))
    points = right.where(F.col(ts).isNotNull()).select(*by, cell(ts).alias("_cell"), point.alias("_p")).groupBy(*by, "_cell").agg(F.array_sort(F.collect_list("_p")).alias("_points"))
    asked = left.select(*by, cell(ts).alias("_cell")).distinct().select("*", F.lit(None).cast(points.schema["_points"].dataType).alias("_points"))
    cells = points.unionByName(asked).groupBy(*by, "_cell").agg(F.first("_points", ignorenulls=True).alias("_points"))
    order = Window.partitionBy(*by or [F.lit(0)])  # a row per cell
    before = order.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    after = order.orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = {"_past": F.last(F.element_at("_points", -1), ignorenulls=True).over(before), "_next": F.last(F.element_at("_points", 1), ignorenulls=True).over(after)}
    near = cells.select(*by, "_cell", "_points", *[ends[c].alias(c) for c in (["_past"] if mode == "backward" else ["_past", "_next"])])
    joined = null_safe_join(left.withColumn("_cell", cell(ts)), near, [*by, "_cell"])
    now = F.unix_micros(ts)
    inside = F.coalesce("_points", F.array().cast(points.schema["_points"].dataType))
    p = F.coalesce(F.try_element_at(F.filter(inside, lambda x: x["t"] <= now), F.lit(-1)), F.col("_past"))
    if mode == "backward":
        hit = p["v"]
    else:
        q = F.coalesce(F.try_element_at(F.filter(inside, lambda x: x["t"] > now), F.lit(1)), F.col("_next"))
        hit = F.when(p["t"] == now, p["v"]).when(q["t"] > p["t"], p["v"] + (q["v"] - p["v"]) * ((now - p["t"]) / (q["t"] - p["t"])))
    return joined.withColumn(out, hit).select(*[F.col(f"`{c}`") for c in left.columns if c != out], out)


def overlapping_windows(windows: DataFrame) -> DataFrame:
    """Windows that start before the previous one (by start) has ended."""
    s = Series(windows.select("start", "end"), [], ["start", "end"], epoch("start"))
    s.shift({"prev_end": (F.col("end"), 1)})
    return s.done().where(F.col("start") < F.col("prev_end"))


def active_or_next_window(states: DataFrame, windows: DataFrame, horizon_min: int) -> DataFrame:
    """First window, by start, that holds the state's time or begins within the horizon.

    A range join cut by day: each window is listed under every day on which a state could see it. A day's windows, few by
    nature, form one sorted array, so a state meets a single row of its day and picks its window there: states are
    neither shuffled by key nor aggregated, and the planner broadcasts the day table while it is small.
    """
    horizon = F.make_interval(mins=F.lit(horizon_min))
    first_day = F.to_date(F.col("start") - horizon)
    last_day = F.to_date(F.col("end"))
    listed = windows.select("start", "end", F.explode(F.sequence(first_day, last_day)).alias("_day"))
    days = listed.groupBy("_day").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_windows"))
    t = F.col("timestamp")

    def sees(w: Column) -> Column:
        return ((w["start"] <= t) & (t < w["end"])) | ((w["start"] > t) & (w["start"] <= t + horizon))

    met = states.withColumn("_day", F.to_date("timestamp")).join(days, "_day", "left").withColumn("_w", F.get(F.filter("_windows", sees), 0))
    return met.select(*states.columns, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"))


def relative_to(df: DataFrame, ref: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    """Savings of each run against the reference run on the same keys, floored at 0.

    ``measures``: {input column: output column}. A missing reference counts as 0.
    """
    r = ref.select(*keys, *[F.col(m).alias(f"_r_{m}") for m in measures])
    zero = F.lit(0.0)
    return (
        df.join(r, keys, "left")
        .withColumns({o: F.greatest(zero, F.coalesce(f"_r_{m}", zero) - F.col(m)) for m, o in measures.items()})
        .drop(*[f"_r_{m}" for m in measures])
    )


# Reasons reported with a forecast.
FORECAST_USED = "used forecast outdoor temperature"
FORECAST_FAILED = "forecast lookup failed, used current outdoor temperature"
FORECAST_EMPTY = "forecast empty for interval, used current outdoor temperature"
FORECAST_MISSING = "forecast missing, used current outdoor temperature"


def interval_mean_forecast(intervals: DataFrame, forecast: DataFrame | None, key: str, start: str, end: str, fallback: str) -> DataFrame:
    """Adds ``outdoor_used`` and ``forecast_reason``: mean of hourly as-of lookups from start, plus the end.

    One failed lookup discards the interval. Rows without an interval keep NULLs.
    """
    if forecast is None:
        has = F.col(end).isNotNull()
        return intervals.withColumns(
            {"outdoor_used": F.when(has, F.col(fallback)), "forecast_reason": F.when(has, F.lit(FORECAST_MISSING))}
        )
    hourly = F.sequence(F.col(start), F.col(end), F.expr("interval 1 hour"))
    points = F.when(F.col(end) <= F.col(start), F.array(start)).otherwise(F.array_distinct(F.array_append(hourly, F.col(end))))
    asked = intervals.where(F.col(end).isNotNull()).select(key, F.explode(points).alias("ts"))
    # The looked-up point is marked as found even when its value is missing.
    found = asof_join(asked, forecast.withColumn("temp", F.coalesce("temp", F.lit(float("nan")))), [], "ts", "temp", "v")
    finite = F.when(~F.isnan("v"), F.col("v"))
    agg = found.groupBy(key).agg(F.avg(finite).alias("_mean"), F.max(F.col("v").isNull()).alias("_failed"))
    reason = (
        F.when(F.col("_failed"), FORECAST_FAILED).when(F.col("_mean").isNull(), FORECAST_EMPTY).otherwise(FORECAST_USED)
    )
    used = F.when(F.col("_failed") | F.col("_mean").isNull(), F.col(fallback)).otherwise(F.col("_mean"))
    known = F.col("_failed").isNotNull()
    return (
        intervals.join(agg, key, "left")
        .withColumns({"outdoor_used": F.when(known, used), "forecast_reason": F.when(known, reason)})
        .drop("_mean", "_failed")
    )
