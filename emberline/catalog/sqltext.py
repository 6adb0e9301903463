"""Common table expressions for the SQL twins. ``{name}`` in a text pulls the expression in, with its own needs."""

from __future__ import annotations

import re

GAP = 1440  # minutes; see the telemetry view

CTES: dict[str, str] = {}

CTES["raw"] = """
SELECT user_id AS home_id, CAST(ts AS TIMESTAMP) AS ts, event_id,
  CAST(year(ts) * 100 + month(ts) AS INTEGER) AS month,
  CASE WHEN event_id % 97 = 5 THEN 0::DOUBLE ELSE CAST(66 + CAST(floor(value) AS BIGINT) % 12 AS DOUBLE) END AS indoor,
  CASE WHEN event_id % 101 = 7 THEN 'NaN'::DOUBLE ELSE CAST(40 + (event_id * 7) % 60 AS DOUBLE) END AS outdoor,
  CASE WHEN event_id % 103 = 9 THEN 'NaN'::DOUBLE ELSE CAST(66 + 2 * (CAST(floor(event_id / 400) AS BIGINT) % 3) AS DOUBLE) END AS heat_sp,
  CASE WHEN event_id % 107 = 11 THEN 0::DOUBLE ELSE CAST(74 + 2 * (CAST(floor(event_id / 700) AS BIGINT) % 3) AS DOUBLE) END AS cool_sp,
  CASE WHEN event_id % 7 = 3 THEN 'NaN'::DOUBLE ELSE CAST(20 + event_id % 61 AS DOUBLE) END AS humidity,
  CASE WHEN event_id % 109 = 13 THEN 'NaN'::DOUBLE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 300::DOUBLE ELSE 0::DOUBLE END AS heat_run,
  CASE WHEN event_type = 'error' AND event_id % 2 = 1 THEN 300::DOUBLE ELSE 0::DOUBLE END AS cool_run
FROM events"""

CTES["tel"] = """
SELECT home_id, ts, event_id, month,
  CASE WHEN isnan(indoor) OR indoor = 0 THEN NULL ELSE indoor END AS indoor,
  CASE WHEN isnan(outdoor) OR outdoor = 0 THEN NULL ELSE outdoor END AS outdoor,
  CASE WHEN isnan(heat_sp) THEN NULL ELSE heat_sp END AS heat_sp,
  CASE WHEN isnan(cool_sp) THEN NULL ELSE cool_sp END AS cool_sp,
  CASE WHEN isnan(humidity) THEN NULL ELSE humidity END AS humidity,
  CASE WHEN isnan(heat_run) THEN NULL ELSE heat_run END AS heat_run,
  CASE WHEN isnan(cool_run) THEN NULL ELSE cool_run END AS cool_run
FROM {raw}"""

CTES["homes"] = "SELECT c_custkey AS home_id, n_name AS state FROM customer JOIN nation ON c_nationkey = n_nationkey"

CTES["moded"] = """
SELECT *, CASE WHEN indoor IS NULL OR heat_sp IS NULL OR cool_sp IS NULL THEN 'invalid'
    WHEN indoor < heat_sp THEN 'heating' WHEN indoor > cool_sp THEN 'cooling' ELSE 'passive' END AS mode,
  CASE WHEN indoor IS NULL OR heat_sp IS NULL OR cool_sp IS NULL THEN 0
    WHEN indoor < heat_sp THEN heat_sp - indoor WHEN indoor > cool_sp THEN indoor - cool_sp ELSE 0 END::DOUBLE AS gap
FROM {tel}"""

CTES["mode_runs"] = """
SELECT home_id, CAST(run AS BIGINT) AS run, mode, min(ts) AS start_ts, count(*) AS duration_steps, max(gap) AS max_gap, avg(gap) AS mean_gap
FROM (SELECT *, sum(CASE WHEN mode = prev THEN 0 ELSE 1 END) OVER (PARTITION BY home_id ORDER BY ts, event_id) AS run
      FROM (SELECT *, lag(mode) OVER (PARTITION BY home_id ORDER BY ts, event_id) AS prev FROM {moded}))
WHERE mode IN ('heating', 'cooling') GROUP BY home_id, run, mode"""

CTES["changes"] = """
SELECT home_id, ts, event_id, indoor, outdoor, kind, delta, old, new FROM (
  SELECT *, unnest([{'kind': 'heat', 'delta': heat_sp - hp, 'old': hp, 'new': heat_sp},
                    {'kind': 'cool', 'delta': cool_sp - cp, 'old': cp, 'new': cool_sp}], recursive := true)
  FROM (SELECT *, lag(heat_sp) OVER w AS hp, lag(cool_sp) OVER w AS cp FROM {tel} WINDOW w AS (PARTITION BY home_id ORDER BY ts, event_id))
  WHERE heat_sp IS NOT NULL AND hp IS NOT NULL AND cool_sp IS NOT NULL AND cp IS NOT NULL)
WHERE abs(delta) >= 1"""

CTES["change_counts"] = """
SELECT h.home_id, n_samples, coalesce(hc, 0) AS n_heat_changes, coalesce(cc, 0) AS n_cool_changes, coalesce(hc, 0) + coalesce(cc, 0) AS n_changes
FROM (SELECT home_id, count(*) AS n_samples FROM {tel} GROUP BY 1 HAVING count(*) >= 60) h
LEFT JOIN (SELECT home_id, count(*) FILTER (kind = 'heat') AS hc, count(*) FILTER (kind = 'cool') AS cc FROM {changes} GROUP BY 1) c USING (home_id)"""

# -- setpoint responses: one recursive step per row --------------------------------------------------
CTES["resp_flags"] = """
SELECT *, i0 = 0 OR h0 = 0 OR c0 = 0 AS zero, lag(i0 = 0 OR h0 = 0 OR c0 = 0) OVER w AS pzero,
  h0 - lag(h0) OVER w AS dh, c0 - lag(c0) OVER w AS dc, row_number() OVER w AS rn
FROM (SELECT *, CASE WHEN isnan(indoor) THEN NULL ELSE indoor END AS i0, CASE WHEN isnan(heat_sp) THEN NULL ELSE heat_sp END AS h0,
  CASE WHEN isnan(cool_sp) THEN NULL ELSE cool_sp END AS c0 FROM {raw})
WINDOW w AS (PARTITION BY home_id, month ORDER BY ts, event_id)"""
CTES["resp_trig"] = """
SELECT * EXCLUDE (zero), coalesce(zero, false) AS zero,
  CASE WHEN coalesce(zero, false) OR coalesce(pzero, rn = 1) THEN NULL WHEN dh > 1 AND i0 < h0 THEN 'heat_increase'
       WHEN dc < -1 AND i0 > c0 THEN 'cool_decrease' END AS trig FROM {resp_flags}"""
CTES["resp_walk"] = """
SELECT home_id, month, rn, NULL::BIGINT AS start_rn, NULL::VARCHAR AS kind, NULL::DOUBLE AS target, NULL::DOUBLE AS t0, NULL::TIMESTAMP AS ts0, false AS member, false AS hit
FROM {resp_trig} WHERE rn = 1
UNION ALL
SELECT f.home_id, f.month, f.rn,
  CASE WHEN s.go THEN w.start_rn WHEN s.begin THEN f.rn END, CASE WHEN s.go THEN w.kind WHEN s.begin THEN f.trig END,
  CASE WHEN s.go THEN w.target WHEN s.begin THEN CASE WHEN f.trig = 'heat_increase' THEN f.h0 ELSE f.c0 END END,
  CASE WHEN s.go THEN w.t0 WHEN s.begin THEN f.i0 END, CASE WHEN s.go THEN w.ts0 WHEN s.begin THEN f.ts END,
  s.go OR s.begin,
  s.go AND CASE WHEN w.kind = 'heat_increase' THEN f.i0 >= w.target ELSE f.i0 <= w.target END
FROM resp_walk w JOIN {resp_trig} f ON f.home_id = w.home_id AND f.month = w.month AND f.rn = w.rn + 1,
LATERAL (SELECT w.member AND NOT w.hit AS open,
  w.member AND NOT w.hit AND NOT f.zero AND NOT coalesce(abs(CASE WHEN w.kind = 'heat_increase' THEN f.h0 ELSE f.c0 END - w.target) > 0.5, false) AS go,
  NOT (w.member AND NOT w.hit) AND f.trig IS NOT NULL AS begin) s"""
CTES["resp"] = """
SELECT r.home_id, r.month, r.ts AS timestamp, r.event_id, r.home_id || '_' || w.kind || '_' || strftime(w.ts0, '%Y-%m-%dT%H:%M:%S') AS episode_id,
  w.kind AS change_type, w.target AS target_setpoint, w.t0 AS start_temp, abs(w.target - w.t0) AS initial_gap,
  w.rn - w.start_rn AS timestep_idx, count(*) OVER (PARTITION BY w.home_id, w.month, w.start_rn) AS n_steps,
  CASE WHEN isnan(r.indoor) THEN NULL ELSE r.indoor END AS indoor, CASE WHEN isnan(r.outdoor) THEN NULL ELSE r.outdoor END AS outdoor,
  CASE WHEN isnan(r.heat_sp) THEN NULL ELSE r.heat_sp END AS heat_sp, CASE WHEN isnan(r.cool_sp) THEN NULL ELSE r.cool_sp END AS cool_sp,
  CASE WHEN isnan(r.humidity) THEN NULL ELSE r.humidity END AS humidity, CASE WHEN isnan(r.heat_run) THEN NULL ELSE r.heat_run END AS heat_run, r.cool_run
FROM {resp_walk} w JOIN {resp_flags} r USING (home_id, month, rn)
WHERE w.member AND (w.home_id, w.month, w.start_rn) IN (SELECT (home_id, month, start_rn) FROM {resp_walk} WHERE hit)"""

# -- drift segments ----------------------------------------------------------------------------------
CTES["num"] = """
SELECT *, row_number() OVER w AS rn, lag(ts) OVER w AS pts, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60000000.0::DOUBLE AS gap_min
FROM {tel} WINDOW w AS (PARTITION BY home_id, month ORDER BY ts, event_id)"""
_SLOPE = """CASE WHEN rn > {n} AND count({c}) OVER w{n} = {m} AND max(gap_min) OVER g{n} <= 1440 AND ts > lag(ts, {n}) OVER w
  THEN ({c} - lag({c}, {n}) OVER w) / ((epoch_us(ts) - epoch_us(lag(ts, {n}) OVER w)) / 3600000000.0::DOUBLE) END AS {c}_slope_{n}"""
_SLOPES = ",\n  ".join(_SLOPE.replace("{n}", str(n)).replace("{m}", str(n + 1)).replace("{c}", c) for n in (3, 6) for c in ("indoor", "outdoor"))
CTES["sloped"] = (
    "SELECT *,\n  "
    + _SLOPES
    + """
FROM {num} WINDOW w AS (PARTITION BY home_id, month ORDER BY ts, event_id),
  w3 AS (PARTITION BY home_id, month ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
  g3 AS (PARTITION BY home_id, month ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
  w6 AS (PARTITION BY home_id, month ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
  g6 AS (PARTITION BY home_id, month ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"""
)
CTES["offs"] = """
SELECT *, (epoch_us(ts) - epoch_us(last_value(CASE WHEN breaks THEN ts END IGNORE NULLS) OVER (PARTITION BY home_id, month ORDER BY ts, event_id))) / 60000000.0::DOUBLE AS off_min
FROM (SELECT *, rn = 1 OR gap_min > 1440 OR NOT coalesce(lag(is_off) OVER (PARTITION BY home_id, month ORDER BY ts, event_id), false) AS breaks
  FROM (SELECT *, indoor IS NOT NULL AND outdoor IS NOT NULL AND NOT (coalesce(heat_run, 0) > 0 OR coalesce(cool_run, 0) > 0) AS is_off FROM {sloped}))"""
CTES["equipped"] = """
SELECT home_id, month, coalesce(max(heat_run) > 0, false) AS has_heat_run, coalesce(max(cool_run) > 0, false) AS has_cool_run
FROM {tel} GROUP BY 1, 2 HAVING coalesce(max(heat_run) > 0, false) OR coalesce(max(cool_run) > 0, false)"""
CTES["seg_in"] = """
SELECT o.*, coalesce(heat_sp, 0) AS h0, coalesce(cool_sp, 0) AS c0, is_off AND abs(indoor - outdoor) >= 3 AS elig
FROM {offs} o SEMI JOIN {equipped} e ON o.home_id = e.home_id AND o.month = e.month"""
CTES["seg_walk"] = """
SELECT home_id, month, rn, CASE WHEN elig THEN rn END AS seg_rn, CASE WHEN elig THEN h0 END AS ah, CASE WHEN elig THEN c0 END AS ac FROM {seg_in} WHERE rn = 1
UNION ALL
SELECT f.home_id, f.month, f.rn, CASE WHEN s.go THEN w.seg_rn WHEN f.elig THEN f.rn END, CASE WHEN s.go THEN w.ah WHEN f.elig THEN f.h0 END, CASE WHEN s.go THEN w.ac WHEN f.elig THEN f.c0 END
FROM seg_walk w JOIN {seg_in} f ON f.home_id = w.home_id AND f.month = w.month AND f.rn = w.rn + 1,
LATERAL (SELECT w.seg_rn IS NOT NULL AND f.is_off AND f.gap_min <= 1440 AND abs(f.h0 - w.ah) <= 1 AND abs(f.c0 - w.ac) <= 1 AS go) s"""
CTES["segs"] = """
SELECT r.home_id, r.month, r.rn, r.ts, r.event_id, r.indoor, r.outdoor, r.heat_sp, r.cool_sp, r.humidity, w.seg_rn, r.rn - w.seg_rn AS timestep_idx,
  b.ts AS start_ts, b.indoor AS start_temp, b.outdoor AS start_outdoor, b.h0 AS start_heat, b.c0 AS start_cool,
  b.indoor_slope_3 AS slope_in_3, b.indoor_slope_6 AS slope_in_6, b.outdoor_slope_3 AS slope_out_3, b.outdoor_slope_6 AS slope_out_6, b.off_min
FROM {seg_walk} w JOIN {seg_in} r USING (home_id, month, rn) JOIN {seg_in} b ON b.home_id = w.home_id AND b.month = w.month AND b.rn = w.seg_rn"""
CTES["passages"] = """
SELECT *, boundary_temp <> 0 AND distance_to_boundary > 0 AS eligible,
  CASE WHEN boundary_temp <> 0 AND distance_to_boundary > 0 THEN crossing_timestep_idx * 5 END AS time_to_boundary_min
FROM (SELECT home_id, month, seg_rn, count(*) AS n_rows, min(timestep_idx) FILTER (CASE WHEN drift_direction = 'cooling_drift' THEN indoor >= boundary_temp ELSE indoor <= boundary_temp END) AS crossing_timestep_idx,
    any_value(start_ts) AS start_ts, any_value(start_temp) AS start_temp, any_value(start_outdoor) AS start_outdoor, any_value(drift_direction) AS drift_direction,
    any_value(target_boundary) AS target_boundary, any_value(boundary_temp) AS boundary_temp, any_value(boundary_temp - start_temp) AS signed_boundary_gap, any_value(abs(boundary_temp - start_temp)) AS distance_to_boundary
  FROM (SELECT *, CASE WHEN start_temp - start_outdoor < 0 THEN 'cooling_drift' ELSE 'warming_drift' END AS drift_direction,
      CASE WHEN start_temp - start_outdoor < 0 THEN 'cool_setpoint' ELSE 'heat_setpoint' END AS target_boundary,
      CASE WHEN start_temp - start_outdoor < 0 THEN start_cool ELSE start_heat END AS boundary_temp FROM {segs})
  GROUP BY home_id, month, seg_rn)"""
CTES["drift"] = """
SELECT s.home_id, s.home_id || '_drift_' || strftime(s.start_ts, '%Y-%m-%dT%H:%M:%S') AS episode_id, s.ts AS timestamp, s.event_id, s.timestep_idx, p.drift_direction,
  s.start_temp, s.start_outdoor, s.start_temp - s.start_outdoor AS initial_delta, p.target_boundary, p.boundary_temp, true AS crossed_boundary,
  p.crossing_timestep_idx, p.time_to_boundary_min, p.distance_to_boundary, p.signed_boundary_gap,
  s.slope_in_3 AS recent_indoor_slope_15m, s.slope_in_6 AS recent_indoor_slope_30m, s.slope_out_3 AS recent_outdoor_slope_15m, s.slope_out_6 AS recent_outdoor_slope_30m,
  s.off_min AS time_since_hvac_off_min, s.indoor, s.outdoor, s.heat_sp, s.cool_sp, s.humidity
FROM {segs} s JOIN {passages} p USING (home_id, month, seg_rn)
WHERE p.eligible AND p.time_to_boundary_min >= 5 AND s.timestep_idx <= p.crossing_timestep_idx"""

# -- samples and splits ------------------------------------------------------------------------------
CTES["home_split"] = """
SELECT home_id, state, CASE WHEN place < 0.7::DOUBLE THEN 'train' WHEN place < 0.7::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, (row_number() OVER (PARTITION BY state ORDER BY md5(home_id || ':42'), home_id) - 1)::DOUBLE / count(*) OVER (PARTITION BY state) AS place FROM {homes})"""
CTES["hsamp"] = """
SELECT home_id, ts, event_id, indoor, outdoor, outdoor_future, heat_sp, cool_sp, target, outdoor - indoor AS outdoor_drive, gap AS gap_to_target, mode,
  (mode = 'heating')::INT::DOUBLE AS is_heating, (mode = 'cooling')::INT::DOUBLE AS is_cooling, CAST(hour(ts) AS BIGINT) AS hour,
  sin(hour(ts) * (2 * pi() / 24)) AS hour_sin, cos(hour(ts) * (2 * pi() / 24)) AS hour_cos
FROM (SELECT *, lead(indoor, 2) OVER w AS target, lead(outdoor, 2) OVER w AS outdoor_future, row_number() OVER w - 1 AS r0 FROM {moded}
      WINDOW w AS (PARTITION BY home_id ORDER BY ts, event_id))
WHERE r0 >= 1 AND (r0 - 1) % 3 = 0 AND indoor IS NOT NULL AND target IS NOT NULL AND outdoor IS NOT NULL AND outdoor_future IS NOT NULL AND heat_sp IS NOT NULL AND cool_sp IS NOT NULL"""
CTES["hsplit"] = "SELECT s.*, split = 'train' AS is_train FROM {hsamp} s JOIN {home_split} h USING (home_id) WHERE split IN ('train', 'test')"
CTES["tsplit"] = """
SELECT * EXCLUDE (rn, n, cut), rn <= cut AS is_train FROM (SELECT *, floor(n * 0.8::DOUBLE) AS cut FROM
  (SELECT *, row_number() OVER (PARTITION BY home_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY home_id) AS n FROM {hsamp}))
WHERE n >= 10 AND n - cut >= 3"""
CTES["act"] = """
SELECT home_id, episode_id, event_id, timestamp, change_type, n_steps * 5 AS duration_min, ln((n_steps * 5)::DOUBLE) AS log_duration, initial_gap, abs(initial_gap) AS abs_gap,
  ln(abs(initial_gap) + 0.1::DOUBLE) AS log_gap, indoor AS start_temp, target_setpoint, outdoor AS outdoor_temp, outdoor - indoor AS outdoor_drive,
  CASE WHEN change_type = 'heat_increase' THEN outdoor - indoor ELSE indoor - outdoor END AS signed_outdoor_drive,
  CAST(hour(timestamp) AS BIGINT) AS hour, CAST(month(timestamp) AS BIGINT) AS month, CAST(isodow(timestamp) - 1 AS BIGINT) AS day_of_week,
  sin(hour(timestamp) * (2 * pi() / 24)) AS hour_sin, cos(hour(timestamp) * (2 * pi() / 24)) AS hour_cos,
  sin(month(timestamp) * (2 * pi() / 12)) AS month_sin, cos(month(timestamp) * (2 * pi() / 12)) AS month_cos,
  coalesce(humidity, 50) AS indoor_humidity, coalesce(heat_run, 0) AS heat_runtime_start, coalesce(cool_run, 0) AS cool_runtime_start,
  CAST(coalesce(heat_run, 0) > 0 OR coalesce(cool_run, 0) > 0 AS BIGINT) AS system_running, CAST(change_type = 'heat_increase' AS BIGINT) AS is_heating
FROM {resp} WHERE timestep_idx = 0 AND outdoor IS NOT NULL AND indoor IS NOT NULL AND n_steps * 5 BETWEEN 5 AND 240"""
_SPLIT = """
SELECT s.*, u.rnk <= greatest(1, floor(u.n * 0.7::DOUBLE)) AS is_train FROM {SRC} s JOIN
  (SELECT home_id, episode_id, row_number() OVER (PARTITION BY home_id ORDER BY md5(episode_id || ':42'), episode_id) AS rnk, count(*) OVER (PARTITION BY home_id) AS n
   FROM (SELECT DISTINCT home_id, episode_id FROM {SRC})) u USING (home_id, episode_id) WHERE u.n >= MIN"""
CTES["asplit"] = _SPLIT.replace("SRC", "act").replace("MIN", "1")
CTES["ewin"] = """
SELECT home_id, episode_id, event_id, change_type, timestep_idx, target_setpoint, start_temp, initial_gap, indoor AS current_temp, outdoor AS outdoor_temp, y_true,
  target_setpoint - indoor AS current_gap, indoor - start_temp AS elapsed_change
FROM (SELECT *, lead(indoor, 1) OVER (PARTITION BY episode_id ORDER BY timestep_idx) AS y_true FROM {resp}) WHERE indoor IS NOT NULL AND y_true IS NOT NULL"""
CTES["esplit"] = _SPLIT.replace("SRC", "ewin").replace("MIN", "2")
CTES["rem"] = """
SELECT home_id, episode_id, change_type, timestep_idx, event_id, initial_gap, target_setpoint - indoor AS current_gap, outdoor - indoor AS outdoor_drive,
  timestep_idx * 5 AS elapsed_min, n_steps * 5 - timestep_idx * 5 AS remaining_min
FROM {resp} WHERE indoor IS NOT NULL AND outdoor IS NOT NULL AND n_steps * 5 - timestep_idx * 5 > 0"""
CTES["rsplit"] = _SPLIT.replace("SRC", "rem").replace("MIN", "2")
CTES["dsamp"] = """
SELECT home_id, episode_id, event_id, timestamp, drift_direction, time_to_boundary_min::DOUBLE AS duration_min, ln(time_to_boundary_min::DOUBLE) AS log_duration, margin,
  ln(margin + 0.1::DOUBLE) AS log_margin, (drift_direction = 'warming_drift')::INT::DOUBLE AS is_heating,
  CASE WHEN drift_direction = 'warming_drift' THEN start_temp - outdoor ELSE outdoor - start_temp END AS signed_outdoor_drive, outdoor AS outdoor_temp, start_temp, start_outdoor, boundary_temp,
  CAST(hour(timestamp) AS BIGINT) AS hour, CAST(month(timestamp) AS BIGINT) AS month, CAST(isodow(timestamp) - 1 AS BIGINT) AS day_of_week,
  sin(hour(timestamp) * (2 * pi() / 24)) AS hour_sin, cos(hour(timestamp) * (2 * pi() / 24)) AS hour_cos,
  sin(month(timestamp) * (2 * pi() / 12)) AS month_sin, cos(month(timestamp) * (2 * pi() / 12)) AS month_cos
FROM (SELECT *, CASE WHEN drift_direction = 'warming_drift' THEN start_temp - boundary_temp ELSE boundary_temp - start_temp END AS margin FROM {drift}
      WHERE timestep_idx = 0 AND time_to_boundary_min BETWEEN 5 AND 480) WHERE margin > 1e-6"""
CTES["dsplit"] = _SPLIT.replace("SRC", "dsamp").replace("MIN", "1")

# -- predictions of the log-log model, the input of the error reports ---------------------------------
_LOGLOG = """
SELECT KEYS, count(*) AS n, avg(log_duration) - covar_pop(log_gap, log_duration) * count(*) / (var_pop(log_gap) * count(*) + 0.1::DOUBLE) * avg(log_gap) AS a,
  covar_pop(log_gap, log_duration) * count(*) / (var_pop(log_gap) * count(*) + 0.1::DOUBLE) AS b FROM {asplit} WHERE is_train GROUP BY KEYS"""
CTES["ll_home"] = "SELECT * FROM (" + _LOGLOG.replace("KEYS", "home_id, change_type") + ") WHERE n >= 5"
CTES["ll_mode"] = _LOGLOG.replace("KEYS", "change_type")
CTES["preds"] = """
SELECT 'log_log' AS model, t.episode_id, t.event_id, t.home_id, t.duration_min::DOUBLE AS actual,
  exp(coalesce(h.a, m.a, 3.5::DOUBLE) + coalesce(CASE WHEN h.a IS NOT NULL THEN h.b END, m.b, 1.0::DOUBLE) * t.log_gap) AS pred,
  t.change_type, t.initial_gap, t.abs_gap, t.system_running, d.state, t.month, t.hour, t.outdoor_temp
FROM {asplit} t LEFT JOIN {ll_home} h ON t.home_id = h.home_id AND t.change_type = h.change_type LEFT JOIN {ll_mode} m ON t.change_type = m.change_type
LEFT JOIN {homes} d ON t.home_id = d.home_id WHERE NOT is_train"""

CTES["hist"] = """
SELECT ['baseline', 'precool', 'setback'][event_id % 3 + 1] AS policy, user_id % 50 AS building, CASE WHEN day(ts) <= 15 THEN 'first_half' ELSE 'second_half' END AS scenario,
  CAST(ts AS TIMESTAMP) AS timestamp, event_id, CAST(66 + CAST(floor(value) AS BIGINT) % 12 AS DOUBLE) AS indoor_temp, value / 10.0::DOUBLE AS hvac_power_kw,
  CAST(66 + 2 * (CAST(floor(event_id / 400) AS BIGINT) % 3) AS DOUBLE) AS heat_setpoint, CAST(74 + 2 * (CAST(floor(event_id / 700) AS BIGINT) % 3) AS DOUBLE) AS cool_setpoint,
  CAST(hour(ts) AS BIGINT) AS hour FROM events"""
_PRICE = "CASE WHEN hour < 12 THEN 0.09 WHEN hour < 16 THEN 0.15 WHEN hour < 21 THEN 0.45 WHEN hour = 21 THEN 0.15 ELSE 0.09 END::DOUBLE"
CTES["kpis"] = f"""
SELECT policy, building, scenario, p * dt AS total_kwh, peak_kw, CASE WHEN m > 0 THEN peak_kw / m ELSE 0 END AS par, pp * dt AS peak_kwh, oob * dt AS comfort_violations_h,
  dd * dt AS discomfort_degree_hours, max_temp_deviation_f, c * dt AS cost_usd
FROM (SELECT policy, building, scenario, coalesce(max(CASE WHEN rn = 2 THEN (epoch_us(timestamp) - epoch_us(pts)) / 3600000000.0::DOUBLE END), 1::DOUBLE) AS dt, sum(hvac_power_kw) AS p, max(hvac_power_kw) AS peak_kw,
    avg(hvac_power_kw) AS m, sum(CASE WHEN hour >= 17 AND hour < 20 THEN hvac_power_kw ELSE 0 END) AS pp, count(*) FILTER (dev > 0) AS oob, sum(dev) AS dd, max(dev) AS max_temp_deviation_f,
    sum(hvac_power_kw * {_PRICE}) AS c
  FROM (SELECT *, greatest(heat_setpoint - 1 - indoor_temp, indoor_temp - cool_setpoint - 1, 0)::DOUBLE AS dev, row_number() OVER w AS rn, lag(timestamp) OVER w AS pts FROM {{hist}}
        WINDOW w AS (PARTITION BY policy, building, scenario ORDER BY timestamp, event_id)) GROUP BY 1, 2, 3)"""
CTES["load"] = """
SELECT event_type AS run, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS step, sum(value) AS consumption_kw, avg((66 + CAST(floor(value) AS BIGINT) % 12 - 32) * 5.0::DOUBLE / 9.0::DOUBLE) AS temp_c
FROM events GROUP BY 1, 2"""
CTES["blocks"] = """
SELECT *, CAST(floor(r0 / 24) AS BIGINT) AS block, r0 % 24 AS slot FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS r0 FROM {load})"""
CTES["daypar"] = """
SELECT run, count(*) FILTER (n = 24) AS n_days, CASE WHEN count(*) FILTER (n = 24) = 0 THEN max(mx) / (sum(sm) / sum(n)) ELSE avg(mx / av) FILTER (n = 24 AND av > 0) END AS daily_par
FROM (SELECT run, block, count(*) AS n, max(consumption_kw) AS mx, avg(consumption_kw) AS av, sum(consumption_kw) AS sm FROM {blocks} GROUP BY 1, 2) GROUP BY run"""

CTES["fc"] = "SELECT date_trunc('hour', ts - to_hours(hour(ts) % 2)) + INTERVAL 7 MINUTE AS ts, avg(outdoor) AS temp FROM {tel} WHERE outdoor IS NOT NULL GROUP BY 1"
CTES["win"] = """
SELECT d + to_hours(a) AS wstart, d + to_hours(b) AS wend FROM (SELECT DISTINCT date_trunc('day', CAST(ts AS TIMESTAMP)) AS d FROM events), (VALUES (13, 14), (17, 20)) h(a, b)"""
CTES["states"] = """
SELECT event_id AS state_id, home_id, ts AS timestamp, indoor AS indoor_temp_f, outdoor AS outdoor_temp_f, coalesce(heat_run, 0) + coalesce(cool_run, 0) > 0 AS system_running,
  CASE WHEN event_id % 2 = 0 THEN 'heating' ELSE 'cooling' END AS mode FROM {tel} WHERE indoor IS NOT NULL AND outdoor IS NOT NULL"""
CTES["picked"] = """
SELECT s.*, w.ws AS window_start, w.we AS window_end FROM {states} s LEFT JOIN
  (SELECT state_id, min(wstart) AS ws, min_by(wend, wstart) AS we FROM {states} JOIN {win} ON (wstart <= timestamp AND timestamp < wend) OR (wstart > timestamp AND wstart <= timestamp + to_minutes(360)) GROUP BY 1) w USING (state_id)"""
CTES["dinput"] = """
SELECT *, CASE WHEN in_window OR minutes_to_start <= 240 THEN CASE WHEN in_window THEN window_end ELSE window_start END END AS until FROM (
  SELECT *, coalesce(timestamp >= window_start, false) AS in_window, (epoch_us(window_start) - epoch_us(timestamp)) / 60000000.0::DOUBLE AS minutes_to_start,
    (epoch_us(window_end) - epoch_us(timestamp)) / 60000000.0::DOUBLE AS minutes_to_end, CASE WHEN mode = 'heating' THEN 72 ELSE 68 END::DOUBLE AS storage_target_f, CASE WHEN mode = 'heating' THEN 68 ELSE 72 END::DOUBLE AS boundary_f FROM {picked})"""
CTES["fpoints"] = """
SELECT DISTINCT state_id, ts FROM (SELECT state_id, unnest(generate_series(timestamp, until, INTERVAL 1 HOUR)) AS ts FROM {dinput} WHERE until IS NOT NULL
  UNION ALL SELECT state_id, until FROM {dinput} WHERE until IS NOT NULL)"""
CTES["fmean"] = """
SELECT d.*, CASE WHEN m.failed THEN d.outdoor_temp_f ELSE m.mean END AS outdoor_used,
  CASE WHEN m.failed THEN 'forecast lookup failed, used current outdoor temperature' WHEN m.failed = false THEN 'used forecast outdoor temperature' END AS forecast_reason
FROM {dinput} d LEFT JOIN (SELECT state_id, avg(temp) AS mean, max(temp IS NULL) AS failed FROM (SELECT p.state_id, f.temp FROM {fpoints} p ASOF LEFT JOIN {fc} f ON p.ts >= f.ts) GROUP BY 1) m USING (state_id)"""

RECURSIVE = {"resp_walk", "seg_walk"}


def compose(sql: str, rnd: list[str] | None = None) -> str:
    """Expand ``{name}`` references into a WITH list in dependency order."""
    order: list[str] = []

    def visit(text: str, me: str | None = None) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name not in CTES:
                raise KeyError(name)
            if name != me and name not in order:
                visit(CTES[name], name)
                order.append(name)

    visit(sql)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    body = plain(sql)
    if rnd:
        body = "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in rnd) + f") FROM ({body})"
    heads = [f"{n} AS {'MATERIALIZED ' if n not in RECURSIVE else ''}({plain(CTES[n])})" for n in order]
    return ("WITH RECURSIVE " + ",\n".join(heads) + "\n" if heads else "") + body
