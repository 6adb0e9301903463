"""Setpoint policies and the peak-window decision, as column rules over joined tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalar import at_or_past, clip, directional_gap, plausible_temperature, violations
from emberline.operators.joins import active_or_next_window, interval_mean_forecast, overlapping_windows

# Default setpoints, peak hours and thermostat limits.
BASE_HEAT, BASE_COOL = 68.0, 76.0
PEAK_START, PEAK_END = 17, 20
HEAT_LIMITS, COOL_LIMITS = (55.0, 75.0), (70.0, 85.0)

Policy = Callable[[], tuple[Column, Column]]


def _hour_in(lo: float, hi: float) -> Column:
    return (F.col("hour") >= lo) & (F.col("hour") < hi)


def policy_baseline(heat: float = BASE_HEAT, cool: float = BASE_COOL) -> tuple[Column, Column]:
    return F.lit(heat), F.lit(cool)


def policy_precool(offset: float = 2.0, lead_hours: float = 2, setback: float = 2.0, start: int = PEAK_START, end: int = PEAK_END, heat: float = BASE_HEAT, cool: float = BASE_COOL) -> tuple[Column, Column]:
    level = F.when(_hour_in(start - lead_hours, start), cool - offset).when(_hour_in(start, end), cool + setback).otherwise(cool)
    return F.lit(heat), level


def policy_preheat(offset: float = 2.0, lead_hours: float = 2, setback: float = 2.0, start: int = PEAK_START, end: int = PEAK_END, heat: float = BASE_HEAT, cool: float = BASE_COOL) -> tuple[Column, Column]:
    level = F.when(_hour_in(start - lead_hours, start), heat + offset).when(_hour_in(start, end), heat - setback).otherwise(heat)
    return level, F.lit(cool)


def policy_setback(magnitude: float = 4.0, mode: str = "cooling", start: int = PEAK_START, end: int = PEAK_END, heat: float = BASE_HEAT, cool: float = BASE_COOL) -> tuple[Column, Column]:
    if mode not in ("cooling", "heating", "both"):
        raise ValueError(f"mode must be cooling, heating or both, got {mode!r}")
    peak = _hour_in(start, end)
    h = F.when(peak, heat - magnitude).otherwise(heat) if mode != "cooling" else F.lit(heat)
    c = F.when(peak, cool + magnitude).otherwise(cool) if mode != "heating" else F.lit(cool)
    return h, c


def policy_price_response(low: float = 0.10, high: float = 0.25, adjust_low: float = -1.0, adjust_high: float = 2.0, heat: float = BASE_HEAT, cool: float = BASE_COOL) -> tuple[Column, Column]:
    p = F.col("electricity_price")
    part = (p - low) / (high - low)
    adjust = F.when(p >= high, adjust_high).when(p <= low, adjust_low).otherwise(adjust_low + part * (adjust_high - adjust_low))
    return F.lit(heat), cool + adjust


def apply_policy(obs: DataFrame, policy: tuple[Column, Column]) -> DataFrame:
    h, c = policy
    return obs.withColumns({"heat_setpoint": h.cast("double"), "cool_setpoint": c.cast("double")})


def clamp_setpoints(heat="heat_setpoint", cool="cool_setpoint") -> dict[str, Column]:
    return {"heat_setpoint": clip(heat, *HEAT_LIMITS), "cool_setpoint": clip(cool, *COOL_LIMITS)}


# First hour, last hour and action level of each strategy, hours 1 to 24; the level at all other hours.
HOUR_ACTIONS = {
    "constant": [],
    "moderate": [(14, 16, 1.0), (17, 20, 0.3), (21, 23, 0.8)],
    "aggressive": [(12, 16, 1.0), (17, 20, 0.1), (21, 23, 1.0)],
}
OTHER_HOURS = {"constant": 0.5, "moderate": 0.7, "aggressive": 0.6}


def hour_schedule_action(df: DataFrame, strategy: str, hour: str = "hour_of_day") -> DataFrame:
    """Action by hour 1 to 24 from a schedule."""
    out = F.when(F.lit(False), F.lit(0.0))
    for first, last, level in HOUR_ACTIONS[strategy]:
        out = out.when(F.col(hour).between(first, last), level)
    return df.withColumn("action", out.otherwise(OTHER_HOURS[strategy]).cast("double"))


# Gain and bias per hour class (normal, preheat, peak).
FEEDBACK_GAINS = {
    "normal": {"normal": (0.5, 0.1), "preheat": (0.5, 0.1), "peak": (0.5, 0.1)},
    "peak_shave": {"normal": (0.5, 0.1), "preheat": (0.8, 0.3), "peak": (0.2, 0.0)},
    "aggressive": {"normal": (0.5, 0.1), "preheat": (1.0, 0.4), "peak": (0.1, 0.0)},
}


def feedback_action(df: DataFrame, strategy: str, hour: str = "hour_of_day", temp: str = "temp_c", setpoint: str = "setpoint_c") -> DataFrame:
    """Proportional control on the shortfall, with gain and bias by hour class, clipped to [0, 1]."""
    gains = FEEDBACK_GAINS[strategy]
    kind = F.when(F.col(hour).between(14, 16), "preheat").when(F.col(hour).between(17, 20), "peak").otherwise("normal")

    def pick(i: int) -> Column:
        out = F.when(kind == "preheat", gains["preheat"][i]).when(kind == "peak", gains["peak"][i])
        return out.otherwise(gains["normal"][i])

    short = F.greatest(F.lit(0.0), F.col(setpoint) - F.col(temp))
    return df.withColumn("action", clip(pick(0) * short + pick(1), 0.0, 1.0))


def check_states(states: DataFrame) -> DataFrame:
    """Rows a controller must refuse, one per broken rule."""
    return violations(
        states,
        {
            "indoor_temp_f must be plausible": plausible_temperature("indoor_temp_f"),
            "outdoor_temp_f must be finite": F.col("outdoor_temp_f").isNotNull() & ~F.isnan("outdoor_temp_f"),
            "mode must be heating or cooling": F.col("mode").isin("heating", "cooling"),
        },
    )


def check_config(config: dict[str, float]) -> dict[str, float]:
    if config["comfort_lower_f"] >= config["comfort_upper_f"]:
        raise ValueError("comfort_lower_f must be less than comfort_upper_f")
    for name in ("horizon_minutes", "precondition_margin_minutes", "drift_safety_margin_minutes", "min_precondition_gap_f", "max_precondition_lead_minutes"):
        if config[name] < 0:
            raise ValueError(f"{name} must be non-negative")
    return config


# Decision defaults.
DEFAULT_CONFIG = {
    "comfort_lower_f": 68.0,
    "comfort_upper_f": 72.0,
    "normal_heat_setpoint_f": 70.0,
    "normal_cool_setpoint_f": 74.0,
    "horizon_minutes": 360,
    "precondition_margin_minutes": 10.0,
    "drift_safety_margin_minutes": 10.0,
    "min_precondition_gap_f": 0.5,
    "max_precondition_lead_minutes": 240.0,
}


def check_windows(windows: DataFrame) -> DataFrame:
    """Raises while planning if windows are empty, reversed or overlap."""
    if not windows.where(F.col("end") <= F.col("start")).isEmpty():
        raise ValueError("peak window end must be after start")
    if not overlapping_windows(windows).isEmpty():
        raise ValueError("peak windows must not overlap")
    return windows


def decision_inputs(states: DataFrame, windows: DataFrame, forecast: DataFrame | None, config: dict[str, float]) -> DataFrame:
    """States with their window, the temperatures they steer to and the outdoor temperature to score with."""
    cfg = {**DEFAULT_CONFIG, **config}
    w = active_or_next_window(states, windows, int(cfg["horizon_minutes"]))
    heating = F.col("mode") == "heating"
    inside = F.coalesce(F.col("timestamp") >= F.col("window_start"), F.lit(False))
    to_start = (F.unix_micros("window_start") - F.unix_micros("timestamp")) / 60000000.0
    lower, upper = F.lit(float(cfg["comfort_lower_f"])), F.lit(float(cfg["comfort_upper_f"]))
    w = w.withColumns(
        {
            "in_window": inside,
            "minutes_to_start": to_start,
            "minutes_to_end": (F.unix_micros("window_end") - F.unix_micros("timestamp")) / 60000000.0,
            "storage_target_f": F.when(heating, upper).otherwise(lower),
            "boundary_f": F.when(heating, lower).otherwise(upper),
        }
    )
    # The forecast is consulted only when the window is open or near enough to prepare for.
    near = inside | (F.col("minutes_to_start") <= cfg["max_precondition_lead_minutes"])
    w = w.withColumn("_until", F.when(near, F.when(inside, F.col("window_end")).otherwise(F.col("window_start"))))
    return interval_mean_forecast(w, forecast, "state_id", "timestamp", "_until", "outdoor_temp_f").drop("_until")


def peak_ladder(scored: DataFrame, config: dict[str, float]) -> DataFrame:
    """Phase, setpoints and reason from inputs plus ``active_minutes`` and ``drift_minutes``."""
    cfg = check_config({**DEFAULT_CONFIG, **config})
    heating = F.col("mode") == "heating"
    lower, upper = float(cfg["comfort_lower_f"]), float(cfg["comfort_upper_f"])
    past = at_or_past("indoor_temp_f", "boundary_f", heating)
    lasts = F.col("drift_minutes") >= F.col("minutes_to_end") + cfg["drift_safety_margin_minutes"]
    far = F.col("minutes_to_start") > cfg["max_precondition_lead_minutes"]
    near_target = directional_gap("indoor_temp_f", "storage_target_f", heating) < cfg["min_precondition_gap_f"]
    due = F.col("minutes_to_start") <= F.col("active_minutes") + cfg["precondition_margin_minutes"]
    tail = F.concat(F.lit("; "), F.coalesce("forecast_reason", F.lit("")))

    def step(phase: str, text: str, with_forecast: bool = True) -> Column:
        reason = F.concat(F.lit(text), tail) if with_forecast else F.lit(text)
        return F.struct(F.lit(phase).alias("phase"), reason.alias("reason"))

    # Phases and the sentences that explain them.
    choice = (
        F.when(F.col("window_start").isNull(), step("normal", "no peak window in horizon", False))
        .when(F.col("in_window") & past, step("peak_maintain", "comfort boundary reached during peak"))
        .when(F.col("in_window") & lasts, step("peak_coast", "predicted drift stays within comfort through peak"))
        .when(F.col("in_window"), step("peak_coast", "defer HVAC until closer to comfort boundary"))
        .when(far, step("normal", "peak window too far away", False))
        .when(near_target, step("normal", "already near storage target"))
        .when(due, step("precondition", "active-time prediction says preconditioning should start"))
        .otherwise(step("normal", "not time to precondition yet"))
    )
    out = scored.withColumn("_s", choice).select("*", "_s.phase", "_s.reason").drop("_s")
    coast = F.col("phase").isin("peak_coast", "peak_maintain")

    def normal(name: str) -> Column:
        v = cfg.get(name)
        return F.lit(None).cast("double") if v is None else clip(F.lit(float(v)), lower, upper)

    heat = F.when(F.col("phase") == "precondition", upper).when(coast, lower).otherwise(normal("normal_heat_setpoint_f"))
    cool = F.when(F.col("phase") == "precondition", lower).when(coast, upper).otherwise(normal("normal_cool_setpoint_f"))
    return out.withColumns({"heat_setpoint_f": F.when(heating, heat), "cool_setpoint_f": F.when(~heating, cool)})


def peak_decision(
    states: DataFrame,
    windows: DataFrame,
    forecast: DataFrame | None,
    config: dict[str, float],
    score: Callable[[DataFrame], DataFrame],
    validate: bool = True,
) -> DataFrame:
    """Decide every state at once. ``score`` adds active_minutes and drift_minutes from ``outdoor_used``."""
    if validate:
        check_windows(windows)
    return peak_ladder(score(decision_inputs(states, windows, forecast, config)), config)
