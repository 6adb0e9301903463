"""Closed-form models: grouped sums fit them, column expressions apply them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalar import clip, clip_no_overshoot
from emberline.plans.lookup import beside, lookup_with_fallback
from emberline.plans.quantiles import agg_with_quantiles

EPS = 1e-8


def origin_slope(train: DataFrame, keys: list[str], x: Column, y: Column, min_n: int = 1, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Least squares through the origin per key, optionally clipped; keys under ``min_n`` rows are left out."""
    k = F.sum(x * y) / (F.sum(x * x) + F.lit(EPS))
    out = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), k.alias("k")).where(F.col("n") >= min_n)
    return out.withColumn("k", clip("k", lo, hi)) if lo is not None else out


def predict_persistence(test: DataFrame, col: str) -> DataFrame:
    return test.withColumn("pred", F.col(col))


def predict_global_mean(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    m = train.agg(F.avg(y).alias("pred"))
    return beside(test, m)


def stage_name(idx: str = "timestep_idx") -> Column:
    return F.when(F.col(idx) < 2, "early").when(F.col(idx) < 6, "mid").otherwise("late")


def gap_fraction(train: DataFrame, test: DataFrame, scope: str) -> DataFrame:
    """Move a learned fraction of the remaining gap. Scope: global, clipped, mode, stage or home."""
    x, y = F.col("current_gap"), F.col("y_true") - F.col("current_temp")
    now = F.col("current_temp")
    zero = F.lit(0.0)
    if scope == "stage":
        train, test = train.withColumn("stage", stage_name()), test.withColumn("stage", stage_name())
    if scope in ("global", "clipped"):
        scored = beside(test, origin_slope(train, [], x, y).select("k")).withColumn("k", F.coalesce("k", zero))
    elif scope == "mode":
        scored = lookup_with_fallback(test, [(origin_slope(train, ["change_type"], x, y), ["change_type"])], "k", zero, "k")
    elif scope == "stage":
        scored = lookup_with_fallback(test, [(origin_slope(train, ["stage"], x, y, 1, 0, 1), ["stage"])], "k", zero, "k")
    elif scope == "home":
        levels = [(origin_slope(train, ["home_id"], x, y, 10, 0, 0.5), ["home_id"]), (origin_slope(train, [], x, y), [])]
        scored = lookup_with_fallback(test, levels, "k", zero, "k")
    else:
        raise ValueError(f"unknown scope {scope!r}")
    out = scored.withColumn("pred", now + F.col("k") * x)
    return out.withColumn("pred", clip_no_overshoot("pred", "target_setpoint", "change_type")) if scope == "clipped" else out


def minutes_per_degree(train: DataFrame, test: DataFrame, scope: str) -> DataFrame:
    """Remaining minutes proportional to the absolute gap. Scope: global, mode, home or home_mode."""
    x, y = F.abs("current_gap"), F.col("remaining_min")
    zero = F.lit(0.0)
    whole = (origin_slope(train, [], x, y), [])
    by_mode = (origin_slope(train, ["change_type"], x, y), ["change_type"])
    levels = {
        "global": [whole],
        "mode": [by_mode],
        "home": [(origin_slope(train, ["home_id"], x, y, 10, 5, 60), ["home_id"]), whole],
        "home_mode": [(origin_slope(train, ["home_id", "change_type"], x, y, 10, 5, 60), ["home_id", "change_type"]), by_mode],
    }[scope]
    default = F.lit(20.0) if scope == "home_mode" else zero
    return lookup_with_fallback(test, levels, "k", default, "k").withColumn("pred", F.col("k") * F.abs("current_gap"))


def linear_rate(train: DataFrame, test: DataFrame, per_home: bool, lo: float = 5.0, hi: float = 480.0) -> DataFrame:
    """Drift minutes proportional to the margin, by direction and optionally home; clipped to [lo, hi]."""
    x, y = F.col("margin"), F.col("duration_min")
    ratio = train.agg((F.avg("duration_min") / F.greatest(F.avg("margin"), F.lit(1e-6))).alias("k"))
    levels = [(origin_slope(train, ["drift_direction"], x, y), ["drift_direction"]), (ratio, [])]
    if per_home:
        keys = ["home_id", "drift_direction"]
        levels = [(origin_slope(train, keys, x, y, 5, lo, hi), keys), *levels]
    scored = lookup_with_fallback(test, levels, "k", F.lit(None).cast("double"), "k")
    return scored.withColumn("pred", clip(F.col("k") * x, lo, hi))


def active_rate_home_mode(train: DataFrame, test: DataFrame) -> DataFrame:
    """Episode minutes proportional to the gap by home and mode (at least 5 episodes, clipped), else by mode."""
    x, y = F.col("abs_gap"), F.col("duration_min")
    keys = ["home_id", "change_type"]
    levels = [(origin_slope(train, keys, x, y, 5, 5, 120), keys), (origin_slope(train, ["change_type"], x, y), ["change_type"])]
    return lookup_with_fallback(test, levels, "k", F.lit(30.0), "k").withColumn("pred", F.col("k") * x)


def group_median(train: DataFrame, test: DataFrame, keys: list[str], y: str) -> DataFrame:
    """Median label per group, the global median for unseen groups."""
    m = agg_with_quantiles(train, keys, [], F.col(y), {"pred": 0.5})
    g = agg_with_quantiles(train, [], [], F.col(y), {"pred": 0.5})
    return lookup_with_fallback(test, [(m, keys), (g, [])], "pred", F.lit(None).cast("double"), "pred")


def drift_regression(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Temperature change on outdoor drive, one slope and intercept; falls back to no change."""
    x, y = F.col("outdoor_drive"), F.col("target") - F.col("indoor")
    fit = train.groupBy(*keys).agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.count(F.lit(1)).alias("n"))
    fit = fit.where(F.col("n") >= 2).select(*keys, "a", "b")
    scored = test.join(fit, keys, "left") if keys else beside(test, fit)
    line = F.coalesce(F.col("a") + F.col("b") * x, F.lit(0.0))
    return scored.withColumn("pred", F.col("indoor") + line).drop("a", "b")


def mode_aware_drift(train: DataFrame, test: DataFrame, keys: list[str], min_n: int = 1) -> DataFrame:
    """Drift to the setpoint of the mode, or to the future outdoor temperature, at a learned rate."""
    goal = F.when(F.col("mode") == "heating", F.col("heat_sp")).when(F.col("mode") == "cooling", F.col("cool_sp")).otherwise(
        F.col("outdoor_future")
    )
    x, y = goal - F.col("indoor"), F.col("target") - F.col("indoor")
    by = [*keys, "mode"]
    k = origin_slope(train, by, x, y, min_n)
    scored = lookup_with_fallback(test, [(k, by)], "k", F.lit(0.0), "k")
    return scored.withColumn("pred", F.col("indoor") + F.col("k") * x)


def log_log_ridge(train: DataFrame, keys: list[str], x: str, y: str, alpha: float = 0.1, min_n: int = 1) -> DataFrame:
    """ln(minutes) on ln(gap) with a ridge slope, from five sums per key: coefficients a and b."""
    n = F.count(F.lit(1))
    mx, my = F.avg(x), F.avg(y)
    sxx = F.var_pop(x) * n
    sxy = F.covar_pop(x, y) * n
    b = sxy / (sxx + F.lit(alpha))
    return (
        train.groupBy(*keys)
        .agg(n.alias("n"), (my - b * mx).alias("a"), b.alias("b"))
        .where(F.col("n") >= min_n)
        .withColumn("ab", F.struct("a", "b"))
    )


def predict_log_log(train: DataFrame, test: DataFrame, mode: str, x: str, default: tuple[float, float], lo: float | None = None, hi: float | None = None) -> DataFrame:
    """By home and mode with at least 5 episodes, else by mode, else the default line."""
    keys = ["home_id", mode]
    levels = [
        (log_log_ridge(train, keys, x, "log_duration", 0.1, 5), keys),
        (log_log_ridge(train, [mode], x, "log_duration"), [mode]),
    ]
    line = F.struct(F.lit(default[0]).alias("a"), F.lit(default[1]).alias("b"))
    scored = lookup_with_fallback(test, levels, "ab", line, "ab")
    pred = F.exp(F.col("ab.a") + F.col("ab.b") * F.col(x))
    return scored.withColumn("pred", clip(pred, lo, hi) if lo is not None else pred).drop("ab")


def target_encoding(train: DataFrame, keys: list[str], y: str, out: str, m: float = 10.0) -> DataFrame:
    """Group mean pulled to the global mean with the weight of m rows."""
    g = train.agg(F.avg(y).alias("_g"))
    stats = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("_m"))
    return beside(stats, g).select(
        *keys, "n", ((F.col("n") * F.col("_m") + m * F.col("_g")) / (F.col("n") + m)).alias(out)
    )


def add_encodings(train: DataFrame, df: DataFrame, mode: str, y: str = "log_duration") -> DataFrame:
    """home_encoded and home_mode_encoded, the global mean for unseen keys."""
    g = train.agg(F.avg(y).alias("_g"))
    out = beside(df, g)
    for keys, name in ((["home_id"], "home_encoded"), (["home_id", mode], "home_mode_encoded")):
        out = lookup_with_fallback(out, [(target_encoding(train, keys, y, name), keys)], name, F.col("_g"), name)
    return out.drop("_g")


def residual_offset(resid: DataFrame, keys: list[str], n0: float = 10.0, min_n: int = 1) -> DataFrame:
    """Mean residual per key, shrunk by n / (n + n0); sparse keys are left out."""
    n = F.col("n")
    return (
        resid.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("_m"))
        .where(n >= min_n)
        .select(*keys, "n", (F.col("_m") * n / (n + n0)).alias("offset"))
    )


def newton_k(steps: DataFrame, step_min: int = 5) -> DataFrame:
    """Decay constant per episode from T(t) = To + (T0 - To) exp(-k t), by least squares in log space.

    ``steps`` carries start_temp and start_outdoor on every row, so one grouped aggregate does it.
    """
    t = (F.col("timestep_idx") * step_min).cast("double")
    ratio = (F.col("indoor") - F.col("start_outdoor")) / F.col("_d0")
    usable = ratio > 0.01
    rows = steps.withColumn("_d0", F.col("start_temp") - F.col("start_outdoor")).where(F.abs("_d0") >= 1.0)
    fit = rows.groupBy("home_id", "episode_id").agg(
        F.count(F.when(usable, 1)).alias("n"), F.sum(F.when(usable, t * t)).alias("_tt"), F.sum(F.when(usable, t * F.log(ratio))).alias("_tl")
    )
    out = fit.where((F.col("n") >= 2) & (F.col("_tt") > 0)).withColumn("k", -F.col("_tl") / F.col("_tt"))
    return out.where((F.col("k") > 0) & (F.col("k") <= 1.0)).select("home_id", "episode_id", "n", "k")


def newton_minutes(k: Column, t0: Column, outdoor: Column, boundary: Column) -> Column:
    """Time to the boundary under exponential decay; NULL where the curve does not cross it."""
    d0 = t0 - outdoor
    ratio = (boundary - outdoor) / F.when(F.abs(d0) >= 0.5, d0)
    return F.when((k > 0) & (ratio > 0) & (ratio < 1), -F.log(ratio) / k)


def newton_predict(train_steps: DataFrame, train: DataFrame, test: DataFrame, per_home: bool) -> DataFrame:
    """Global or per-home (at least 3 fits) median k; rows the curve cannot answer take the train median."""
    ks = newton_k(train_steps)
    levels = [(agg_with_quantiles(ks, [], [], F.col("k"), {"k_mid": 0.5}), [])]
    if per_home:
        homes = agg_with_quantiles(ks, ["home_id"], [F.count(F.lit(1)).alias("n")], F.col("k"), {"k_mid": 0.5}).where(F.col("n") >= 3)
        levels = [(homes, ["home_id"]), *levels]
    scored = lookup_with_fallback(test, levels, "k_mid", F.lit(None).cast("double"), "k")
    mid = agg_with_quantiles(train, [], [], F.col("duration_min"), {"_mid": 0.5})
    minutes = newton_minutes(F.col("k"), F.col("start_temp"), F.col("start_outdoor"), F.col("boundary_temp"))
    return (
        beside(scored, mid).withColumn("pred", F.greatest(F.lit(5.0), F.coalesce(minutes, F.col("_mid")))).drop("_mid")
    )


def predict_trend(test: DataFrame, now: str = "indoor", past: str = "indoor_past", ahead: float = 1.0) -> DataFrame:
    """The last change goes on for ``ahead`` times its own length; without an earlier reading the value stays."""
    return test.withColumn("pred", F.col(now) + F.coalesce(F.col(now) - F.col(past), F.lit(0.0)) * ahead)


def decay_goal() -> Column:
    """What the indoor temperature moves to: the setpoint it is beyond, else the outdoor temperature ahead."""
    return F.when(F.col("mode") == "heating", F.col("heat_sp")).when(F.col("mode") == "cooling", F.col("cool_sp")).otherwise(F.col("outdoor_future"))


def fit_decay(train: DataFrame, minutes: float, taus: list[float]) -> DataFrame:
    """(mode, n, tau, sse): the time constant of least squared error by mode, out of ``taus``.

    With f = exp(-minutes / tau), the error is a quadratic in f, so three sums by mode serve every tau: one aggregate whatever the
    grid. Of equal errors the smallest tau wins.
    """
    y, x = F.col("target") - decay_goal(), F.col("indoor") - decay_goal()
    sums = train.groupBy("mode").agg(F.count(x * y).alias("n"), F.sum(x * x).alias("_xx"), F.sum(x * y).alias("_xy"), F.sum(F.when(x.isNotNull(), y * y)).alias("_yy"))
    f = lambda tau: F.exp(F.lit(-minutes) / tau)
    errors = F.transform(F.array(*[F.lit(float(t)) for t in sorted(taus)]), lambda tau: F.struct((F.col("_yy") - 2 * f(tau) * F.col("_xy") + f(tau) * f(tau) * F.col("_xx")).alias("sse"), tau.alias("tau")))
    best = F.array_min(errors)
    return sums.where("n > 0").select("mode", "n", best["tau"].alias("tau"), F.greatest(best["sse"], F.lit(0.0)).alias("sse"))


def predict_decay(train: DataFrame, test: DataFrame, minutes: float, taus: list[float]) -> DataFrame:
    """Exponential approach to the goal of the mode; a mode not seen in training stays where it is."""
    scored = lookup_with_fallback(test, [(fit_decay(train, minutes, taus), ["mode"])], "tau", F.lit(None).cast("double"), "_tau")
    moved = decay_goal() + (F.col("indoor") - decay_goal()) * F.exp(F.lit(-minutes) / F.col("_tau"))
    return scored.withColumn("pred", F.coalesce(moved, F.col("indoor"))).drop("_tau")
