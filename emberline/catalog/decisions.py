"""Setpoint decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.catalog.models import artifacts
from emberline.catalog.registry import query
from emberline.functions.scalar import directional_gap, drift_margin, tou_price
from emberline.operators import boosting, decide
from emberline.sources.adapters import forecast, history, peak_windows, telemetry, thermostat_states


def observed(spark, sf):
    return history(spark, sf).select("event_id", "hour", tou_price("hour").alias("electricity_price"))


def _applied(spark, sf, policy):
    return decide.apply_policy(observed(spark, sf), policy).select("event_id", "heat_setpoint", "cool_setpoint")


@query("SELECT event_id, 68::DOUBLE AS heat_setpoint, 76::DOUBLE AS cool_setpoint FROM {hist}")
def policy_baseline(spark, sf):
    return _applied(spark, sf, decide.policy_baseline())


@query("SELECT event_id, 68::DOUBLE AS heat_setpoint, CASE WHEN hour IN (15, 16) THEN 74 WHEN hour IN (17, 18, 19) THEN 78 ELSE 76 END::DOUBLE AS cool_setpoint FROM {hist}")
def policy_precool(spark, sf):
    return _applied(spark, sf, decide.policy_precool())


@query("SELECT event_id, CASE WHEN hour IN (15, 16) THEN 70 WHEN hour IN (17, 18, 19) THEN 66 ELSE 68 END::DOUBLE AS heat_setpoint, 76::DOUBLE AS cool_setpoint FROM {hist}")
def policy_preheat(spark, sf):
    return _applied(spark, sf, decide.policy_preheat())


@query(
    """SELECT mode, event_id, CASE WHEN mode <> 'cooling' AND hour IN (17, 18, 19) THEN 64 ELSE 68 END::DOUBLE AS heat_setpoint, CASE WHEN mode <> 'heating' AND hour IN (17, 18, 19) THEN 80 ELSE 76 END::DOUBLE AS cool_setpoint
    FROM {hist}, (VALUES ('cooling'), ('heating'), ('both')) m(mode)"""
)
def policy_setback(spark, sf):
    o = observed(spark, sf)
    out = None
    for mode in ("cooling", "heating", "both"):
        one = decide.apply_policy(o, decide.policy_setback(mode=mode)).select(F.lit(mode).alias("mode"), "event_id", "heat_setpoint", "cool_setpoint")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """SELECT event_id, 68::DOUBLE AS heat_setpoint, 76 + CASE WHEN p >= 0.25 THEN 2 WHEN p <= 0.1 THEN -1 ELSE -1 + (p - 0.1) / (0.25 - 0.1) * 3 END AS cool_setpoint
    FROM (SELECT event_id, CASE WHEN hour < 12 THEN 0.09 WHEN hour < 16 THEN 0.15 WHEN hour < 21 THEN 0.45 WHEN hour = 21 THEN 0.15 ELSE 0.09 END::DOUBLE AS p FROM {hist})""",
    "cool_setpoint",
)
def policy_price_response(spark, sf):
    return _applied(spark, sf, decide.policy_price_response())


@query(
    """SELECT strategy, event_id, CASE strategy WHEN 'constant' THEN 0.5 WHEN 'moderate' THEN CASE WHEN h BETWEEN 14 AND 16 THEN 1 WHEN h BETWEEN 17 AND 20 THEN 0.3 WHEN h BETWEEN 21 AND 23 THEN 0.8 ELSE 0.7 END
      ELSE CASE WHEN h BETWEEN 12 AND 16 THEN 1 WHEN h BETWEEN 17 AND 20 THEN 0.1 WHEN h BETWEEN 21 AND 23 THEN 1 ELSE 0.6 END END::DOUBLE AS action
    FROM (SELECT event_id, hour + 1 AS h FROM {hist}), (VALUES ('constant'), ('moderate'), ('aggressive')) s(strategy)"""
)
def hour_schedule_action(spark, sf):
    o = observed(spark, sf).withColumn("hour_of_day", F.col("hour") + 1)
    out = None
    for s in decide.HOUR_ACTIONS:
        one = decide.hour_schedule_action(o, s).select(F.lit(s).alias("strategy"), "event_id", "action")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """SELECT strategy, event_id, greatest(0, least(1, kp * greatest(0, 70 - indoor) + bias)) AS action FROM (SELECT *, CASE WHEN strategy = 'normal' THEN 0.5 WHEN h BETWEEN 14 AND 16 THEN CASE strategy WHEN 'peak_shave' THEN 0.8 ELSE 1 END WHEN h BETWEEN 17 AND 20 THEN CASE strategy WHEN 'peak_shave' THEN 0.2 ELSE 0.1 END ELSE 0.5 END::DOUBLE AS kp,
        CASE WHEN strategy = 'normal' THEN 0.1 WHEN h BETWEEN 14 AND 16 THEN CASE strategy WHEN 'peak_shave' THEN 0.3 ELSE 0.4 END WHEN h BETWEEN 17 AND 20 THEN 0 ELSE 0.1 END::DOUBLE AS bias
      FROM (SELECT event_id, hour(ts) + 1 AS h, indoor FROM {tel} WHERE indoor IS NOT NULL), (VALUES ('normal'), ('peak_shave'), ('aggressive')) s(strategy))""",
    "action",
)
def feedback_action(spark, sf):
    o = telemetry(spark, sf).where(F.col("indoor").isNotNull()).select(
        "event_id", (F.hour("ts") + 1).alias("hour_of_day"), F.col("indoor").alias("temp_c"), F.lit(70.0).alias("setpoint_c")
    )
    out = None
    for s in decide.FEEDBACK_GAINS:
        one = decide.feedback_action(o, s).select(F.lit(s).alias("strategy"), "event_id", "action")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_id, greatest(55, least(75, indoor_temp)) AS heat_setpoint, greatest(70, least(85, indoor_temp)) AS cool_setpoint FROM {hist}")
def clamp_setpoints(spark, sf):
    h = history(spark, sf).select("event_id", *[c.alias(n) for n, c in decide.clamp_setpoints("indoor_temp", "indoor_temp").items()])
    return h


def supplied_minutes(df):
    """Stand-in for the learned scores, simple enough to restate in SQL."""
    heating = F.col("mode") == "heating"
    return df.withColumns(
        {
            "active_minutes": 25.0 * directional_gap("indoor_temp_f", "storage_target_f", heating),
            "drift_minutes": 30.0 * drift_margin("indoor_temp_f", "boundary_f", heating) + F.coalesce("outdoor_used", F.lit(0.0)) / 2,
        }
    )


@query(
    """SELECT state_id, phase, reason, CASE WHEN mode = 'heating' THEN CASE WHEN phase = 'precondition' THEN 72 WHEN phase = 'normal' THEN 70 ELSE 68 END END::DOUBLE AS heat_setpoint_f,
      CASE WHEN mode = 'cooling' THEN CASE WHEN phase = 'precondition' THEN 68 ELSE 72 END END::DOUBLE AS cool_setpoint_f
    FROM (SELECT *, CASE WHEN window_start IS NULL OR (NOT in_window AND (minutes_to_start > 240 OR gap < 0.5 OR minutes_to_start > 25 * gap + 10)) THEN 'normal' WHEN NOT in_window THEN 'precondition' WHEN at_edge THEN 'peak_maintain' ELSE 'peak_coast' END AS phase,
        CASE WHEN window_start IS NULL THEN 'no peak window in horizon' WHEN NOT in_window AND minutes_to_start > 240 THEN 'peak window too far away' ELSE
          CASE WHEN in_window THEN CASE WHEN at_edge THEN 'comfort boundary reached during peak' WHEN 30 * margin + outdoor_used / 2 >= minutes_to_end + 10 THEN 'predicted drift stays within comfort through peak' ELSE 'defer HVAC until closer to comfort boundary' END
            WHEN gap < 0.5 THEN 'already near storage target' WHEN minutes_to_start <= 25 * gap + 10 THEN 'active-time prediction says preconditioning should start' ELSE 'not time to precondition yet' END || '; ' || forecast_reason END AS reason
      FROM (SELECT *, greatest(0, CASE WHEN mode = 'heating' THEN 72 - indoor_temp_f ELSE indoor_temp_f - 68 END) AS gap, greatest(0, CASE WHEN mode = 'heating' THEN indoor_temp_f - 68 ELSE 72 - indoor_temp_f END) AS margin,
        CASE WHEN mode = 'heating' THEN indoor_temp_f <= 68 ELSE indoor_temp_f >= 72 END AS at_edge FROM {fmean}))"""
)
def peak_decision(spark, sf):
    d = decide.peak_decision(thermostat_states(spark, sf), peak_windows(spark, sf), forecast(spark, sf), {}, supplied_minutes)
    return d.select("state_id", "phase", "reason", "heat_setpoint_f", "cool_setpoint_f")


@query()
def peak_decision_learned(spark, sf):
    """The same decision with minutes from the two boosted models."""
    active, drift = artifacts(spark, sf)

    def score(df):
        df = df.withColumn("outdoor_known", F.coalesce("outdoor_used", "outdoor_temp_f"))
        a = boosting.score_active(df, active, "storage_target_f", "outdoor_known")
        return boosting.score_drift(a, drift, "boundary_f", "outdoor_known")

    d = decide.peak_decision(thermostat_states(spark, sf), peak_windows(spark, sf), forecast(spark, sf), {}, score)
    return d.select("state_id", "phase", "reason", "heat_setpoint_f", "cool_setpoint_f")
