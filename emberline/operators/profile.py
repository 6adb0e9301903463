"""Mode, setpoint-change and gradient profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalar import bucketize, comfort_mode, gradient_class, setpoint_gap
from emberline.plans.quantiles import agg_with_quantiles
from emberline.plans.series import identity, telemetry_series


def mode_share(t: DataFrame) -> DataFrame:
    """Percent of a home's valid samples in each mode."""
    m = t.select("home_id", comfort_mode().alias("mode")).where(F.col("mode") != "invalid")
    return m.groupBy("home_id").agg(
        F.count(F.lit(1)).alias("n_valid"),
        *[(F.avg((F.col("mode") == k).cast("double")) * 100).alias(f"{k}_pct") for k in ("heating", "cooling", "passive")],
    )


def mode_episodes(t: DataFrame) -> DataFrame:
    """Maximal runs of heating or cooling. An invalid row ends a run like any other change of mode."""
    s = telemetry_series(t.select(*identity(t), comfort_mode().alias("mode"), setpoint_gap().alias("gap")))
    s.shift({"prev": (F.col("mode"), 1)})
    s.cumsum({"run": F.when(F.col("mode").eqNullSafe(F.col("prev")), 0).otherwise(1).cast("long")})
    active = s.done().where(F.col("mode").isin("heating", "cooling"))
    return active.groupBy("home_id", "run", "mode").agg(
        F.min("ts").alias("start_ts"),
        F.count(F.lit(1)).alias("duration_steps"),
        F.max("gap").alias("max_gap"),
        F.avg("gap").alias("mean_gap"),
    )


def setpoint_changes(t: DataFrame, min_delta: float = 1.0) -> DataFrame:
    """One row per setpoint move of at least ``min_delta``; a pair with any missing setpoint is skipped."""
    s = telemetry_series(t.select(*identity(t), "indoor", "outdoor", "heat_sp", "cool_sp"))
    s.shift({"heat_prev": (F.col("heat_sp"), 1), "cool_prev": (F.col("cool_sp"), 1)})
    full = s.done().where(
        F.col("heat_sp").isNotNull() & F.col("heat_prev").isNotNull() & F.col("cool_sp").isNotNull() & F.col("cool_prev").isNotNull()
    )
    sides = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("kind"),
                    (F.col(f"{k}_sp") - F.col(f"{k}_prev")).alias("delta"),
                    F.col(f"{k}_prev").alias("old"),
                    F.col(f"{k}_sp").alias("new"),
                )
                for k in ("heat", "cool")
            ]
        )
    )
    return full.select(*identity(t), "indoor", "outdoor", sides).where(F.abs("delta") >= min_delta)


def setpoint_change_counts(t: DataFrame, min_rows: int = 100, min_delta: float = 1.0) -> DataFrame:
    """Changes per home, zero included; homes with fewer than ``min_rows`` rows are dropped."""
    s = telemetry_series(t.select(*identity(t), "heat_sp", "cool_sp"))
    s.shift({"heat_prev": (F.col("heat_sp"), 1), "cool_prev": (F.col("cool_sp"), 1)})
    moves = {k: F.col(f"{k}_sp") - F.col(f"{k}_prev") for k in ("heat", "cool")}
    whole = moves["heat"].isNotNull() & moves["cool"].isNotNull()
    counts = s.done().groupBy("home_id").agg(
        F.count(F.lit(1)).alias("n_samples"), *[F.count_if(whole & (F.abs(d) >= min_delta)).alias(f"n_{k}_changes") for k, d in moves.items()]
    )
    return counts.where(F.col("n_samples") >= min_rows).withColumn("n_changes", F.col("n_heat_changes") + F.col("n_cool_changes"))


def describe(df: DataFrame, col: str, percents: list[int], by: list[str] | None = None) -> DataFrame:
    """Count, mean, median, population standard deviation, extremes and percentiles."""
    v = F.col(col)
    aggs = [
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).cast("double").alias("min"),
        F.max(v).cast("double").alias("max"),
    ]
    probs = {"median": 0.5, **{f"p{p}": p / 100 for p in percents}}
    return agg_with_quantiles(df, by or [], aggs, v, probs)


def histogram(df: DataFrame, bucket: Column, by: list[str] | None = None) -> DataFrame:
    """Rows and percent per bucket. The share window runs over the few bucket rows, not the data."""
    by = by or []
    n = df.select(*by, bucket.alias("bucket")).where(F.col("bucket").isNotNull()).groupBy(*by, "bucket").agg(
        F.count(F.lit(1)).alias("n")
    )
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return n.withColumn("pct", 100 * F.col("n") / total)


# Edges and labels of the profile buckets.
DURATION_EDGES = [0, 5, 10, 15, 30, 60, 120, 240, math.inf]
DURATION_LABELS = ["<=5min", "5-10min", "10-15min", "15-30min", "30-60min", "1-2hr", "2-4hr", ">4hr"]
GAP_EDGES = [0, 0.5, 1, 2, 3, 5, 10, math.inf]
GAP_LABELS = ["<=0.5F", "0.5-1F", "1-2F", "2-3F", "3-5F", "5-10F", ">10F"]
MAGNITUDE_EDGES = [1, 2, 3, 5, 10, math.inf]
MAGNITUDE_LABELS = ["1-2F", "2-3F", "3-5F", "5-10F", ">10F"]
CHANGE_EDGES = [0, 0, 1, 10, 11, 50, 51, 100, 101, 500, 501, 1000, 1001, math.inf]
CHANGE_LABELS = ["0", "1-10", "11-50", "51-100", "101-500", "501-1000", ">1000"]


def duration_bucket(x) -> Column:
    return bucketize(x, DURATION_EDGES, DURATION_LABELS, "right")


def gap_bucket(x) -> Column:
    return bucketize(x, GAP_EDGES, GAP_LABELS, "right")


def magnitude_bucket(x) -> Column:
    return bucketize(x, MAGNITUDE_EDGES, MAGNITUDE_LABELS, "left")


def change_count_bucket(x) -> Column:
    return bucketize(x, CHANGE_EDGES, CHANGE_LABELS, "both")


def threshold_share(df: DataFrame, col: str, limit: float, by: list[str]) -> DataFrame:
    """Percent of rows at or under a limit."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.avg((F.col(col) <= limit).cast("double")) * 100).alias("pct_within"))


def change_direction_split(changes: DataFrame) -> DataFrame:
    up, down = (F.col("delta") > 0), (F.col("delta") < 0)
    return changes.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(up, 1)).alias("n_up"),
        F.count(F.when(down, 1)).alias("n_down"),
        (F.avg(up.cast("double")) * 100).alias("up_pct"),
        (F.avg(down.cast("double")) * 100).alias("down_pct"),
    )


def gradient_totals(t: DataFrame) -> DataFrame:
    """Samples per class with the share of all valid samples and of the class's own mode."""
    n = t.select(gradient_class().alias("gradient")).where(F.col("gradient") != "invalid").groupBy("gradient").agg(
        F.count(F.lit(1)).alias("n")
    )
    family = F.element_at(F.split("gradient", "_"), -1)
    w_all, w_mode = Window.partitionBy(F.lit(0)), Window.partitionBy("mode")
    return (
        n.withColumn("mode", family)
        .withColumn("pct_all", 100 * F.col("n") / F.sum("n").over(w_all))
        .withColumn("pct_mode", 100 * F.col("n") / F.sum("n").over(w_mode))
    )


def home_threshold_table(counts: DataFrame, thresholds: list[int] = [10, 50, 100, 200, 500]) -> DataFrame:
    """Homes reaching each threshold and their changes, in one pass: each home row feeds its thresholds."""
    reach = F.explode(F.array(*[F.lit(t).cast("long") for t in thresholds]))
    hit = F.col("n_changes") >= F.col("threshold")
    return (
        counts.select("n_changes", reach.alias("threshold"))
        .groupBy("threshold")
        .agg(
            F.count(F.when(hit, 1)).alias("n_homes"),
            F.coalesce(F.sum(F.when(hit, F.col("n_changes"))), F.lit(0)).cast("long").alias("total_changes"),
        )
    )


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Sorted limit: each task keeps k rows. ``order`` must end in a unique tie-breaker."""
    return df.orderBy(*order).limit(k)


def home_features(t: DataFrame, sensors: list[str], max_gap_min: float = 10.0, min_readings: int = 100) -> DataFrame:
    """One row per home: equipment, sensors, typical setpoints, decay rate when off, and entropy of the heating schedule.

    ``equipment`` says which run times are ever above zero; ``n_sensors`` counts columns with more than ``min_readings`` values. ``decay_per_hour`` pools, over pairs of neighbouring
    readings with the equipment off at both and at most ``max_gap_min`` apart, the slope of the logarithm of the indoor-outdoor difference
    (the first reading's outdoor temperature, at least one degree away). ``schedule_entropy`` is in bits, over heating setpoints weighted with the minutes they hold, to the
    next reading and at most ``max_gap_min``. Everything comes from one order of the readings; homes without usable pairs have no rate.
    """
    used = sorted({*sensors, "indoor", "outdoor", "heat_sp", "cool_sp", "heat_run", "cool_run"})
    s = telemetry_series(t.select(*identity(t), *used))
    off = ~((F.coalesce(F.col("heat_run"), F.lit(0.0)) > 0) | (F.coalesce(F.col("cool_run"), F.lit(0.0)) > 0))
    s.shift({"_next": (F.unix_micros("ts"), -1), "_in": (F.col("indoor"), -1), "_off": (off, -1)})
    hours = (F.col("_next") - F.unix_micros("ts")) / F.lit(3_600_000_000.0)
    near = hours * 60 <= max_gap_min
    away = F.col("indoor") - F.col("outdoor")
    ratio = F.when(off & F.col("_off") & near & (hours > 0) & (F.abs(away) >= 1), (F.col("_in") - F.col("outdoor")) / away)
    fall = F.when(ratio > 0.01, F.log(ratio))
    rows = s.done().withColumns({"_held": F.least(hours * 60, F.lit(max_gap_min)), "_h": F.when(fall.isNotNull(), hours), "_fall": fall})
    # By home and setpoint first: the entropy needs those sums, and everything else adds up from them.
    runs = {c: F.coalesce(F.max(c) > 0, F.lit(False)) for c in ("heat_run", "cool_run")}
    by_setpoint = rows.groupBy("home_id", "heat_sp").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"_n_{c}") for c in {*sensors, "cool_sp"}], F.sum("cool_sp").alias("_cool"), F.sum("_held").alias("_w"),
        F.sum(F.col("_h") * F.col("_fall")).alias("_hf"), F.sum(F.col("_h") * F.col("_h")).alias("_hh"), *[v.alias(f"_{c}") for c, v in runs.items()],
    )
    w = F.when(F.col("heat_sp").isNotNull(), F.coalesce("_w", F.lit(0.0)))
    heat, cool = F.max("_heat_run"), F.max("_cool_run")
    n_heat = F.sum(F.when(F.col("heat_sp").isNotNull(), F.col("n")))
    total, plogs = F.sum(w), F.sum(F.when(w > 0, w * F.log2(w)).otherwise(0.0))
    return by_setpoint.groupBy("home_id").agg(
        F.sum("n").alias("n"),
        F.when(heat & cool, "both").when(heat, "heating").when(cool, "cooling").otherwise("none").alias("equipment"),
        sum(((F.sum(f"_n_{c}") > min_readings).cast("int") for c in sensors), F.lit(0)).alias("n_sensors"),
        (F.sum(F.col("heat_sp") * F.col("n")) / n_heat).alias("typical_heat"),
        (F.sum("_cool") / F.nullif(F.sum("_n_cool_sp"), F.lit(0))).alias("typical_cool"),
        (-F.sum("_hf") / F.nullif(F.sum("_hh"), F.lit(0.0))).alias("decay_per_hour"),
        F.when(total > 0, F.greatest(F.log2(total) - plogs / total, F.lit(0.0))).alias("schedule_entropy"),
    )
