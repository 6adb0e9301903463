"""Row-level rules as Column builders. A missing input is NULL: NaN sorts above every number in Spark."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def nan_to_null(x) -> Column:
    return F.nanvl(_c(x), F.lit(None).cast("double"))


def sentinel_to_null(x) -> Column:
    return F.nullif(nan_to_null(x), F.lit(0.0))


def null_sentinels(df: DataFrame, zero_cols: list[str], nan_cols: list[str]) -> DataFrame:
    """``zero_cols`` lose 0 and NaN, ``nan_cols`` lose NaN only."""
    return df.withColumns({**{c: sentinel_to_null(c) for c in zero_cols}, **{c: nan_to_null(c) for c in nan_cols}})


def comfort_mode(indoor="indoor", heat="heat_sp", cool="cool_sp") -> Column:
    i, h, c = _c(indoor), _c(heat), _c(cool)
    return (
        F.when(i.isNull() | h.isNull() | c.isNull(), "invalid")
        .when(i < h, "heating")
        .when(i > c, "cooling")
        .otherwise("passive")
    )


def setpoint_gap(indoor="indoor", heat="heat_sp", cool="cool_sp") -> Column:
    """Distance to the violated setpoint, 0 inside the band or when invalid."""
    i, h, c = _c(indoor), _c(heat), _c(cool)
    return (
        F.when(i.isNull() | h.isNull() | c.isNull(), 0.0).when(i < h, h - i).when(i > c, i - c).otherwise(0.0)
    )


def gradient_class(indoor="indoor", outdoor="outdoor", heat="heat_sp", cool="cool_sp") -> Column:
    """Whether the weather works against (active) or with (passive) the setpoint; ties count as passive."""
    i, o, h, c = _c(indoor), _c(outdoor), _c(heat), _c(cool)
    return (
        F.when(i.isNull() | o.isNull() | h.isNull() | c.isNull(), "invalid")
        .when(i < h, F.when(o < i, "active_heating").otherwise("passive_heating"))
        .when(i > c, F.when(o > i, "active_cooling").otherwise("passive_cooling"))
        .otherwise("deadband")
    )


def outdoor_drive(indoor="indoor", outdoor="outdoor") -> Column:
    return _c(outdoor) - _c(indoor)


def signed_active_drive(heating: Column, indoor="indoor", outdoor="outdoor") -> Column:
    return F.when(heating, outdoor_drive(indoor, outdoor)).otherwise(-outdoor_drive(indoor, outdoor))


def signed_drift_drive(heating: Column, indoor="indoor", outdoor="outdoor") -> Column:
    """Positive when the weather speeds the drift to the boundary."""
    return -signed_active_drive(heating, indoor, outdoor)


def cyclic(part: Column, period: int) -> tuple[Column, Column]:
    angle = part * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def time_features(ts="ts") -> dict[str, Column]:
    t = _c(ts)
    hs, hc = cyclic(F.hour(t), 24)
    ms, mc = cyclic(F.month(t), 12)
    return {
        "hour": F.hour(t).cast("long"),
        "month_of_year": F.month(t).cast("long"),
        "day_of_week": F.weekday(t).cast("long"),
        "day_of_year": F.dayofyear(t).cast("long"),
        "hour_sin": hs,
        "hour_cos": hc,
        "month_sin": ms,
        "month_cos": mc,
    }


def hour_from_string(s) -> Column:
    """Hour of a 'date time' text, 12 when it does not parse."""
    return F.coalesce(F.hour(F.try_to_timestamp(_c(s))), F.lit(12)).cast("long")


def log_shifted(x) -> Column:
    return F.log(F.abs(_c(x)) + F.lit(0.1))


def fill_default(x, value: float) -> Column:
    return F.coalesce(nan_to_null(x), F.lit(float(value)))


def equipment_running(columns: list[str]) -> Column:
    """Any listed run time above zero; missing values count as not running."""
    flags = [F.coalesce(nan_to_null(c) > 0, F.lit(False)) for c in columns]
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def bucketize(x, edges: list[float], labels: list[str], closed: str = "left") -> Column:
    """Label of the interval holding x: ``left`` [lo,hi), ``right`` (lo,hi], ``both`` [lo,hi]; NULL outside."""
    v = _c(x)
    pairs = list(zip(edges[::2], edges[1::2])) if closed == "both" else list(zip(edges[:-1], edges[1:]))
    if len(pairs) != len(labels):
        raise ValueError("one label per interval is required")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for (lo, hi), label in zip(pairs, labels):
        left = v > lo if closed == "right" else v >= lo
        right = v < hi if closed == "left" else v <= hi
        if hi == math.inf:
            right = v.isNotNull()
        out = out.when(left & right, label)
    return out


def clamp(x, lo, hi) -> Column:
    """Clip to [lo, hi]; NULL and non-finite values become the upper bound."""
    v = _c(x)
    lo, hi = (b if isinstance(b, Column) else F.lit(float(b)) for b in (lo, hi))
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf))
    return F.when(bad, hi).otherwise(F.greatest(lo, F.least(hi, v)))


def clip(x, lo, hi) -> Column:
    """Plain clip that keeps NULL."""
    v = _c(x)
    return F.when(v.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v)))


def clip_no_overshoot(pred, target, change_type) -> Column:
    p, t, k = _c(pred), _c(target), _c(change_type)
    return F.when(k == "heat_increase", F.least(p, t)).when(k == "cool_decrease", F.greatest(p, t)).otherwise(p)


# Time-of-use price per kWh for hours 0 to 23.
TOU_PRICES = [0.09] * 12 + [0.15] * 4 + [0.45] * 5 + [0.15] + [0.09] * 2


def tou_price(hour, prices: list[float] = TOU_PRICES) -> Column:
    table = F.array(*[F.lit(float(p)) for p in prices])
    return F.element_at(table, (_c(hour) % 24 + 1).cast("int"))


def hvac_mode(heat_kw, cool_kw) -> Column:
    return F.when(_c(heat_kw) > 0, "heating").when(_c(cool_kw) > 0, "cooling").otherwise("off")


def c_to_f(c) -> Column:
    return _c(c) * 9.0 / 5.0 + 32.0


def f_to_c(f) -> Column:
    return (_c(f) - 32.0) * 5.0 / 9.0


def w_to_kw(w) -> Column:
    return _c(w) / 1000.0


def joules_to_watts(joules, seconds) -> Column:
    return _c(joules) / (seconds if isinstance(seconds, Column) else F.lit(float(seconds)))


def directional_gap(current, target, heating: Column) -> Column:
    """How far current still is from a target it must move to, never below 0."""
    c, t = _c(current), _c(target)
    return F.when(heating, F.greatest(t - c, F.lit(0.0))).otherwise(F.greatest(c - t, F.lit(0.0)))


def drift_margin(current, boundary, heating: Column) -> Column:
    """How far current may still drift before it meets the boundary, never below 0."""
    return directional_gap(current, boundary, ~heating)


def at_or_past(current, boundary, heating: Column) -> Column:
    return F.when(heating, _c(current) <= _c(boundary)).otherwise(_c(current) >= _c(boundary))


def episode_id(home, kind, start) -> Column:
    return F.concat_ws("_", _c(home).cast("string"), _c(kind), F.date_format(_c(start), "yyyy-MM-dd'T'HH:mm:ss"))


def drift_direction(indoor, outdoor, heat, cool) -> Column:
    """Struct of direction, boundary name and value, signed gap and distance; setpoints missing count as 0."""
    i, o = _c(indoor), _c(outdoor)
    cooling = (i - o) < 0
    boundary = F.when(cooling, F.coalesce(_c(cool), F.lit(0.0))).otherwise(F.coalesce(_c(heat), F.lit(0.0)))
    return F.struct(
        F.when(cooling, "cooling_drift").otherwise("warming_drift").alias("drift_direction"),
        F.when(cooling, "cool_setpoint").otherwise("heat_setpoint").alias("target_boundary"),
        boundary.alias("boundary_temp"),
        (boundary - i).alias("signed_boundary_gap"),
        F.abs(boundary - i).alias("distance_to_boundary"),
    )


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule: the input row plus ``rule``. A rule that evaluates to NULL is broken."""
    broken = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]),
        lambda r: r.isNotNull(),
    )
    return df.withColumn("rule", F.explode(broken))


def plausible_temperature(x, lo: float = -50.0, hi: float = 150.0) -> Column:
    v = _c(x)
    return v.isNotNull() & ~F.isnan(v) & v.between(lo, hi)
