"""Supervised samples, splits and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalar import (
    comfort_mode,
    fill_default,
    log_shifted,
    setpoint_gap,
    signed_active_drive,
    signed_drift_drive,
    outdoor_drive,
    time_features,
)
from emberline.plans.series import Series, hash_series, identity, telemetry_series

SEED = 42


def horizon_samples(t: DataFrame, horizon: int = 6, stride: int = 72, offset: int = 5, past: int | None = None) -> DataFrame:
    """Every ``stride``-th row from ``offset`` (0-based) with the state ``horizon`` rows later; invalid rows dropped.

    With ``past`` also ``indoor_past``, the temperature so many rows before, missing or not.
    """
    s = telemetry_series(t.select(*identity(t), "indoor", "outdoor", "heat_sp", "cool_sp")).row_number()
    s.shift(
        {
            "target": (F.col("indoor"), -horizon),
            "outdoor_future": (F.col("outdoor"), -horizon),
            **({"indoor_past": (F.col("indoor"), past)} if past else {}),
        }
    )
    r0 = F.col("rn") - 1
    picked = s.done().where((r0 >= offset) & ((r0 - offset) % stride == 0))
    whole = picked.where(
        F.col("indoor").isNotNull()
        & F.col("target").isNotNull()
        & F.col("outdoor").isNotNull()
        & F.col("outdoor_future").isNotNull()
        & F.col("heat_sp").isNotNull()
        & F.col("cool_sp").isNotNull()
    )
    tf = time_features("ts")
    mode = comfort_mode()
    return whole.select(
        *identity(t),
        "indoor",
        "outdoor",
        "outdoor_future",
        "heat_sp",
        "cool_sp",
        "target",
        outdoor_drive().alias("outdoor_drive"),
        setpoint_gap().alias("gap_to_target"),
        mode.alias("mode"),
        (mode == "heating").cast("double").alias("is_heating"),
        (mode == "cooling").cast("double").alias("is_cooling"),
        tf["hour"].alias("hour"),
        tf["hour_sin"].alias("hour_sin"),
        tf["hour_cos"].alias("hour_cos"),
        *(["indoor_past"] if past else []),
    )


def elapsed_remaining(e: DataFrame, step_min: int = 5) -> DataFrame:
    """Per step: minutes since the start and minutes left. The step count comes with the episode table."""
    el = F.col("timestep_idx") * step_min
    left = F.col("n_steps") * step_min - el
    return e.where(F.col("indoor").isNotNull() & F.col("outdoor").isNotNull()).select(
        "home_id",
        "episode_id",
        "change_type",
        "timestep_idx",
        "event_id",
        "initial_gap",
        (F.col("target_setpoint") - F.col("indoor")).alias("current_gap"),
        (F.col("outdoor") - F.col("indoor")).alias("outdoor_drive"),
        el.alias("elapsed_min"),
        left.alias("remaining_min"),
    ).where(F.col("remaining_min") > 0)


def episode_series(e: DataFrame) -> Series:
    return Series(e, ["episode_id"], ["timestep_idx"], F.col("timestep_idx").cast("double"))


def episode_windows(e: DataFrame, horizon: int = 3) -> DataFrame:
    """Within-episode samples with the temperature ``horizon`` steps ahead; short episodes yield none."""
    s = episode_series(e).shift({"y_true": (F.col("indoor"), -horizon)})
    return (
        s.done()
        .where(F.col("indoor").isNotNull() & F.col("y_true").isNotNull())
        .select(
            "home_id",
            "episode_id",
            "event_id",
            "change_type",
            "timestep_idx",
            "target_setpoint",
            "start_temp",
            "initial_gap",
            F.col("indoor").alias("current_temp"),
            F.col("outdoor").alias("outdoor_temp"),
            "y_true",
            (F.col("target_setpoint") - F.col("indoor")).alias("current_gap"),
            (F.col("indoor") - F.col("start_temp")).alias("elapsed_change"),
        )
    )


def rate_extrapolation(windows: DataFrame, step_min: int = 5, ahead_min: int = 15) -> DataFrame:
    """Continue the average rate seen so far; at the start the rate is 0."""
    el = F.col("timestep_idx") * step_min
    rate = F.when(el > 0, F.col("elapsed_change") / el).otherwise(0.0)
    return windows.withColumn("pred", F.col("current_temp") + rate * ahead_min)


def active_episode_samples(e: DataFrame, step_min: int = 5, lo: float = 5, hi: float = 240) -> DataFrame:
    """One row per response: first-step features and the duration label within [lo, hi]."""
    heating = F.col("change_type") == "heat_increase"
    heat0, cool0 = fill_default("heat_run", 0), fill_default("cool_run", 0)
    tf = time_features("timestamp")
    dur = F.col("n_steps") * step_min
    first = e.where((F.col("timestep_idx") == 0) & F.col("outdoor").isNotNull() & F.col("indoor").isNotNull())
    return first.where(dur.between(lo, hi)).select(
        "home_id",
        "episode_id",
        "event_id",
        "timestamp",
        "change_type",
        dur.cast("long").alias("duration_min"),
        F.log(dur.cast("double")).alias("log_duration"),
        "initial_gap",
        F.abs("initial_gap").alias("abs_gap"),
        log_shifted("initial_gap").alias("log_gap"),
        F.col("indoor").alias("start_temp"),
        "target_setpoint",
        F.col("outdoor").alias("outdoor_temp"),
        outdoor_drive().alias("outdoor_drive"),
        signed_active_drive(heating).alias("signed_outdoor_drive"),
        tf["hour"].alias("hour"),
        tf["month_of_year"].alias("month"),
        tf["day_of_week"].alias("day_of_week"),
        tf["hour_sin"].alias("hour_sin"),
        tf["hour_cos"].alias("hour_cos"),
        tf["month_sin"].alias("month_sin"),
        tf["month_cos"].alias("month_cos"),
        fill_default("humidity", 50).alias("indoor_humidity"),
        heat0.alias("heat_runtime_start"),
        cool0.alias("cool_runtime_start"),
        ((heat0 > 0) | (cool0 > 0)).cast("long").alias("system_running"),
        heating.cast("long").alias("is_heating"),
    )


def early_runtime(e: DataFrame, n: int = 3) -> DataFrame:
    """Run time over an episode's first n steps, missing as 0. Only those steps are read."""
    return e.where(F.col("timestep_idx") < n).groupBy("episode_id").agg(
        F.sum(fill_default("heat_run", 0)).alias("early_heat_runtime"), F.sum(fill_default("cool_run", 0)).alias("early_cool_runtime")
    )


def drift_samples(e: DataFrame, lo: float = 5, hi: float = 480) -> DataFrame:
    """One row per drift episode of both directions: margin, features, duration label."""
    warming = F.col("drift_direction") == "warming_drift"
    margin = F.when(warming, F.col("start_temp") - F.col("boundary_temp")).otherwise(F.col("boundary_temp") - F.col("start_temp"))
    tf = time_features("timestamp")
    dur = F.col("time_to_boundary_min")
    starts = e.where((F.col("timestep_idx") == 0) & F.col("crossed_boundary") & dur.between(lo, hi)).withColumn("margin", margin)
    return starts.where(F.col("margin") > 1e-6).select(
        "home_id",
        "episode_id",
        "event_id",
        "timestamp",
        "drift_direction",
        dur.cast("double").alias("duration_min"),
        F.log(dur.cast("double")).alias("log_duration"),
        "margin",
        log_shifted("margin").alias("log_margin"),
        warming.cast("double").alias("is_heating"),
        signed_drift_drive(warming, "start_temp", "outdoor").alias("signed_outdoor_drive"),
        F.col("outdoor").alias("outdoor_temp"),
        "start_temp",
        "start_outdoor",
        "boundary_temp",
        tf["hour"].alias("hour"),
        tf["month_of_year"].alias("month"),
        tf["day_of_week"].alias("day_of_week"),
        tf["hour_sin"].alias("hour_sin"),
        tf["hour_cos"].alias("hour_cos"),
        tf["month_sin"].alias("month_sin"),
        tf["month_cos"].alias("month_cos"),
    )


def temporal_split(samples: DataFrame, frac: float = 0.8, min_samples: int = 100, min_test: int = 10) -> DataFrame:
    """A home's first samples train, the rest test; homes too small on either count are skipped."""
    s = telemetry_series(samples).row_number("_rn").total({"_n": F.lit(1).cast("long")})
    cut = F.floor(F.col("_n") * F.lit(frac))
    keep = (F.col("_n") >= min_samples) & (F.col("_n") - cut >= min_test)
    return s.done().where(keep).withColumn("is_train", F.col("_rn") <= cut).drop("_rn", "_n")


def within_group_split(df: DataFrame, group: list[str], unit: str, frac: float = 0.7, seed: int = SEED, min_units: int = 1) -> DataFrame:
    """Random split of units inside each group, repeatable anywhere: max(1, floor(frac n)) units train."""
    units = df.select(*group, unit).distinct()
    s = hash_series(units, group, unit, seed).row_number("_rank").total({"_n": F.lit(1).cast("long")})
    cut = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(frac)))
    flags = s.done().where(F.col("_n") >= min_units).select(*group, unit, (F.col("_rank") <= cut).alias("is_train"))
    return df.join(flags, [*group, unit])


def cross_group_split(df: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """Train or test by the stored split of the key; validation keys are held out."""
    s = split.where(F.col("split").isin("train", "test")).select(key, (F.col("split") == "train").alias("is_train"))
    return df.join(s, key)


def stratified_split(dim: DataFrame, unit: str, stratum: str, train: float = 0.7, val: float = 0.1, seed: int = SEED) -> DataFrame:
    """train / val / test per stratum by rank of a seeded digest."""
    s = hash_series(dim.select(unit, stratum), [stratum], unit, seed).row_number("_rank").total({"_n": F.lit(1).cast("long")})
    place = (F.col("_rank") - 1) / F.col("_n")
    return s.done().select(
        unit, stratum, F.when(place < train, "train").when(place < train + val, "val").otherwise("test").alias("split")
    )


def dense_ids(df: DataFrame, key: str, order: list[str], position: Column, name: str = "dense_id") -> DataFrame:
    """Number keys 0..n-1 by first appearance: ranks come from the key table, never a global row window."""
    firsts = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_f")).select(key, "_f.*")
    s = Series(firsts, [], [*order, key], position)
    ids = s.row_number("_r").done().select(key, (F.col("_r") - 1).alias(name))
    return df.join(ids, key)


def first_row_label(e: DataFrame, step_min: int = 5) -> DataFrame:
    """Time to target on an episode's first row only, when some row reached it."""
    hit = F.when(
        F.when(F.col("change_type") == "heat_increase", F.col("indoor") >= F.col("target_setpoint")).otherwise(
            F.col("indoor") <= F.col("target_setpoint")
        ),
        F.col("timestep_idx"),
    )
    # A window, since joining an aggregate of its own would run the episodes twice; it spills, and its key is one episode.
    j = e.withColumn("_hit", F.min(hit).over(Window.partitionBy("episode_id")))
    return j.withColumn("time_to_target_min", F.when(F.col("timestep_idx") == 0, F.col("_hit") * step_min)).drop("_hit")


def first_n_homes(t: DataFrame, n: int) -> DataFrame:
    """All rows of the n smallest home ids."""
    ids = t.select("home_id").distinct().orderBy("home_id").limit(n)
    return t.join(ids, "home_id", "left_semi")


def sample_keys(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """All rows of exactly n keys drawn without replacement (all keys if there are fewer)."""
    if n <= 0:
        raise ValueError("sample size must be positive")
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    ids = df.select(key).distinct().orderBy(digest, key).limit(n)
    return df.join(ids, key, "left_semi")


def cap_per_group(df: DataFrame, group: list[str], unit: str, n: int, seed: int = SEED) -> DataFrame:
    """At most n random rows per group. Two or three groups may hold all rows, so ranks are chunked."""
    s = hash_series(df, group, unit, seed).row_number("_rank")
    return s.done().where(F.col("_rank") <= n).drop("_rank", "_h")


def allocate_quota(dim: DataFrame, key: str, n: int) -> DataFrame:
    """Split n over numeric keys in order: n div m each, one more for the first n mod m."""
    s = Series(dim.select(key), [], [key], F.col(key).cast("double"))
    m = s.row_number("_i").total({"_m": F.lit(1).cast("long")}).done()
    base = F.floor(F.lit(n) / F.col("_m"))
    extra = F.when(F.col("_i") <= F.lit(n) % F.col("_m"), 1).otherwise(0)
    return m.select(key, (base + extra).cast("long").alias("quota"))


def capped_training_samples(tasks: dict[str, tuple[DataFrame, str]], cap: int = 80_000, seed: int = SEED) -> DataFrame:
    """Episode samples of several tasks under one roof, at most ``cap`` random ones of each task and direction.

    ``tasks``: {task: (samples, its direction column)}. Columns that all tasks have are kept, beside ``task`` and ``direction``.
    """
    common = [c for c in next(iter(tasks.values()))[0].columns if all(c in df.columns for df, _ in tasks.values())]
    rows = [df.select(F.lit(task).alias("task"), F.col(direction).alias("direction"), *common) for task, (df, direction) in tasks.items()]
    return cap_per_group(reduce(DataFrame.unionByName, rows), ["task", "direction"], "episode_id", cap, seed)
