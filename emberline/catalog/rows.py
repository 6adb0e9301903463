"""Row rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.catalog.registry import query
from emberline.functions import scalar as fn
from emberline.sources.adapters import history, raw_telemetry, telemetry

ID = ["home_id", "event_id"]


@query(
    """SELECT home_id, event_id, indoor, outdoor, heat_sp, cool_sp FROM {tel}"""
)
def null_sentinels(spark, sf):
    return fn.null_sentinels(raw_telemetry(spark, sf), ["indoor", "outdoor"], ["heat_sp", "cool_sp"]).select(*ID, "indoor", "outdoor", "heat_sp", "cool_sp")


@query("SELECT home_id, event_id, mode, gap FROM {moded}")
def comfort_mode(spark, sf):
    return telemetry(spark, sf).select(*ID, fn.comfort_mode().alias("mode"), fn.setpoint_gap().alias("gap"))


@query(
    """SELECT home_id, event_id, CASE WHEN mode = 'invalid' OR outdoor IS NULL THEN 'invalid' WHEN mode = 'passive' THEN 'deadband'
      WHEN mode = 'heating' THEN CASE WHEN outdoor < indoor THEN 'active_heating' ELSE 'passive_heating' END
      ELSE CASE WHEN outdoor > indoor THEN 'active_cooling' ELSE 'passive_cooling' END END AS gradient FROM {moded}"""
)
def gradient_class(spark, sf):
    return telemetry(spark, sf).select(*ID, fn.gradient_class().alias("gradient"))


@query(
    """SELECT home_id, event_id, outdoor - indoor AS outdoor_drive, CASE WHEN event_id % 2 = 0 THEN outdoor - indoor ELSE indoor - outdoor END AS active_drive,
      CASE WHEN event_id % 2 = 0 THEN indoor - outdoor ELSE outdoor - indoor END AS drift_drive FROM {tel}""",
    "outdoor_drive active_drive drift_drive",
)
def outdoor_drive(spark, sf):
    heating = F.col("event_id") % 2 == 0
    return telemetry(spark, sf).select(
        *ID, fn.outdoor_drive().alias("outdoor_drive"), fn.signed_active_drive(heating).alias("active_drive"), fn.signed_drift_drive(heating).alias("drift_drive")
    )


@query(
    """SELECT event_id, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos, sin(2 * pi() * month(ts) / 12) AS month_sin, cos(2 * pi() * month(ts) / 12) AS month_cos FROM events""",
    "hour_sin hour_cos month_sin month_cos",
)
def cyclic_time(spark, sf):
    t = fn.time_features("ts")
    return telemetry(spark, sf).select("event_id", *[t[k].alias(k) for k in ("hour_sin", "hour_cos", "month_sin", "month_cos")])


@query(
    """SELECT event_id, CAST(hour(ts) AS BIGINT) AS hour, CAST(month(ts) AS BIGINT) AS month_of_year, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week, CAST(dayofyear(ts) AS BIGINT) AS day_of_year FROM events"""
)
def calendar_parts(spark, sf):
    t = fn.time_features("ts")
    return telemetry(spark, sf).select("event_id", *[t[k].alias(k) for k in ("hour", "month_of_year", "day_of_week", "day_of_year")])


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 12 ELSE CAST(hour(ts) AS BIGINT) END AS hour FROM events")
def hour_from_string(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return telemetry(spark, sf).select("event_id", fn.hour_from_string(text).alias("hour"))


@query(
    """SELECT event_id, ln(abs(heat_sp - indoor) + 0.1::DOUBLE) AS log_gap, ln(abs(outdoor - indoor) + 0.1::DOUBLE) AS log_delta FROM {tel}""",
    "log_gap log_delta",
)
def log_features(spark, sf):
    return telemetry(spark, sf).select(
        "event_id", fn.log_shifted(F.col("heat_sp") - F.col("indoor")).alias("log_gap"), fn.log_shifted(F.col("outdoor") - F.col("indoor")).alias("log_delta")
    )


@query("SELECT event_id, coalesce(humidity, 50) AS humidity, coalesce(heat_run, 0) AS heat_run, coalesce(cool_run, 0) AS cool_run FROM {tel}")
def fill_defaults(spark, sf):
    return raw_telemetry(spark, sf).select("event_id", *[fn.fill_default(c, v).alias(c) for c, v in (("humidity", 50), ("heat_run", 0), ("cool_run", 0))])


@query("SELECT event_id, CAST(coalesce(heat_run, 0) > 0 OR coalesce(cool_run, 0) > 0 AS BIGINT) AS system_running FROM {tel}")
def system_running(spark, sf):
    return raw_telemetry(spark, sf).select("event_id", fn.equipment_running(["heat_run", "cool_run"]).cast("long").alias("system_running"))


@query("SELECT event_id, coalesce(heat_run, 0) > 0 OR coalesce(cool_run, 0) > 0 AS running FROM {tel}")
def equipment_running(spark, sf):
    return raw_telemetry(spark, sf).select("event_id", fn.equipment_running(["heat_run", "cool_run"]).alias("running"))


@query("SELECT home_id, run, duration_steps * 5 AS duration_min FROM {mode_runs} WHERE duration_steps * 5 BETWEEN 10 AND 240")
def duration_filter(spark, sf):
    from emberline.operators.profile import mode_episodes
    from emberline.sources.telemetry import between

    m = mode_episodes(telemetry(spark, sf)).select("home_id", "run", (F.col("duration_steps") * 5).alias("duration_min"))
    return m.where(between("duration_min", 10, 240))


@query(
    """SELECT event_id, CASE WHEN d >= 0 AND d < 1 THEN 'a' WHEN d >= 1 AND d < 5 THEN 'b' WHEN d >= 5 AND d < 20 THEN 'c' END AS b_left,
      CASE WHEN d > 0 AND d <= 1 THEN 'a' WHEN d > 1 AND d <= 5 THEN 'b' WHEN d > 5 AND d <= 20 THEN 'c' END AS b_right,
      CASE WHEN d BETWEEN 0 AND 1 THEN 'a' WHEN d BETWEEN 2 AND 5 THEN 'b' WHEN d >= 6 THEN 'c' END AS b_both FROM (SELECT event_id, abs(indoor - outdoor) AS d FROM {tel})"""
)
def bucketize(spark, sf):
    d = F.abs(F.col("indoor") - F.col("outdoor"))
    return telemetry(spark, sf).select(
        "event_id",
        fn.bucketize(d, [0, 1, 5, 20], ["a", "b", "c"], "left").alias("b_left"),
        fn.bucketize(d, [0, 1, 5, 20], ["a", "b", "c"], "right").alias("b_right"),
        fn.bucketize(d, [0, 1, 2, 5, 6, float("inf")], ["a", "b", "c"], "both").alias("b_both"),
    )


@query("SELECT event_id, CASE WHEN isnan(outdoor) THEN 80 ELSE greatest(50, least(80, outdoor)) END AS clamped FROM {raw}")
def clamp(spark, sf):
    return raw_telemetry(spark, sf).select("event_id", fn.clamp("outdoor", 50.0, 80.0).alias("clamped"))


@query(
    """SELECT episode_id, timestep_idx, CASE WHEN change_type = 'heat_increase' THEN least(indoor + 2, target_setpoint) ELSE greatest(indoor - 2, target_setpoint) END AS pred FROM {resp}"""
)
def clip_no_overshoot(spark, sf):
    from emberline.catalog.episodes import responses

    e = responses(spark, sf)
    raw = F.when(F.col("change_type") == "heat_increase", F.col("indoor") + 2).otherwise(F.col("indoor") - 2)
    return e.select("episode_id", "timestep_idx", fn.clip_no_overshoot(raw, "target_setpoint", "change_type").alias("pred"))


@query(
    """SELECT event_id, unnest(list_filter([CASE WHEN isnan(outdoor) OR outdoor < -50 OR outdoor > 150 THEN 'outdoor' END, CASE WHEN isnan(heat_sp) OR heat_sp >= cool_sp THEN 'band' END], lambda x : x IS NOT NULL)) AS rule FROM {raw}"""
)
def validate_domain(spark, sf):
    rules = {"outdoor": fn.plausible_temperature("outdoor"), "band": fn.nan_to_null("heat_sp") < fn.nan_to_null("cool_sp")}
    return fn.violations(raw_telemetry(spark, sf), rules).select("event_id", "rule")


@query(
    """SELECT event_id, CASE WHEN hour < 12 THEN 0.09 WHEN hour < 16 THEN 0.15 WHEN hour < 21 THEN 0.45 WHEN hour = 21 THEN 0.15 ELSE 0.09 END::DOUBLE AS price FROM {hist}"""
)
def tou_price(spark, sf):
    return history(spark, sf).select("event_id", fn.tou_price("hour").alias("price"))


@query("SELECT event_id, CASE WHEN heat_run > 0 THEN 'heating' WHEN cool_run > 0 THEN 'cooling' ELSE 'off' END AS hvac_mode FROM {tel}")
def hvac_mode_from_power(spark, sf):
    return telemetry(spark, sf).select("event_id", fn.hvac_mode("heat_run", "cool_run").alias("hvac_mode"))


@query(
    """SELECT event_id, (indoor - 32) * 5 / 9 AS indoor_c, ((indoor - 32) * 5 / 9) * 9 / 5 + 32 AS indoor_f, heat_run / 1000 AS kw, cool_run * 1000 / 300 AS watts FROM {tel}""",
    "indoor_c indoor_f kw watts",
)
def unit_convert(spark, sf):
    return telemetry(spark, sf).select(
        "event_id", fn.f_to_c("indoor").alias("indoor_c"), fn.c_to_f(fn.f_to_c("indoor")).alias("indoor_f"), fn.w_to_kw("heat_run").alias("kw"),
        fn.joules_to_watts(F.col("cool_run") * 1000, 300).alias("watts"),
    )


@query(
    """SELECT event_id, greatest(CASE WHEN event_id % 2 = 0 THEN 72 - indoor ELSE indoor - 68 END, 0) AS gap, greatest(CASE WHEN event_id % 2 = 0 THEN indoor - 68 ELSE 72 - indoor END, 0) AS margin FROM {tel} WHERE indoor IS NOT NULL"""
)
def directional_gap(spark, sf):
    heating = F.col("event_id") % 2 == 0
    t = telemetry(spark, sf).where(F.col("indoor").isNotNull())
    target, edge = F.when(heating, 72.0).otherwise(68.0), F.when(heating, 68.0).otherwise(72.0)
    return t.select("event_id", fn.directional_gap("indoor", target, heating).alias("gap"), fn.drift_margin("indoor", edge, heating).alias("margin"))


@query("SELECT event_id, home_id || '_' || mode || '_' || strftime(ts, '%Y-%m-%dT%H:%M:%S') AS episode_id FROM {moded}")
def episode_id(spark, sf):
    return telemetry(spark, sf).select("event_id", fn.episode_id("home_id", fn.comfort_mode(), "ts").alias("episode_id"))


@query(
    """SELECT event_id, CASE WHEN indoor - outdoor < 0 THEN 'cooling_drift' ELSE 'warming_drift' END AS drift_direction, CASE WHEN indoor - outdoor < 0 THEN 'cool_setpoint' ELSE 'heat_setpoint' END AS target_boundary, b AS boundary_temp, b - indoor AS signed_boundary_gap, abs(b - indoor) AS distance_to_boundary
    FROM (SELECT *, CASE WHEN indoor - outdoor < 0 THEN coalesce(cool_sp, 0) ELSE coalesce(heat_sp, 0) END AS b FROM {tel})"""
)
def drift_direction(spark, sf):
    d = fn.drift_direction("indoor", "outdoor", "heat_sp", "cool_sp")
    return telemetry(spark, sf).select("event_id", d.alias("d")).select("event_id", "d.*")
