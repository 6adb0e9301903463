"""Least-squares models from gram sums, and the random-intercept model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalar import clip
from emberline.operators.rates import residual_offset
from emberline.plans.linear import gram, linear_value, solve, unpack
from emberline.plans.lookup import beside, lookup_with_fallback
from emberline.plans.staging import stage, unstage

# outdoor_drive is outdoor minus indoor, so beside both of them it adds nothing and is left out.
HORIZON_FEATURES = {
    "weather": ["indoor", "outdoor", "heat_sp", "cool_sp"],
    "mode": ["indoor", "outdoor", "heat_sp", "cool_sp", "is_heating", "is_cooling"],
    "gap": ["indoor", "outdoor", "heat_sp", "cool_sp", "is_heating", "is_cooling", "gap_to_target"],
    "time": ["indoor", "outdoor", "heat_sp", "cool_sp", "is_heating", "is_cooling", "gap_to_target", "hour_sin", "hour_cos"],
}
HORIZON_FEATURES["full"] = HORIZON_FEATURES["time"]
# Per mode, gap = setpoint - indoor (or the reverse), so one of the pair is enough.
MODE_FEATURES = {
    "heating": ["indoor", "outdoor", "hour_sin", "hour_cos", "heat_sp"],
    "cooling": ["indoor", "outdoor", "hour_sin", "hour_cos", "cool_sp"],
    "passive": ["indoor", "outdoor", "hour_sin", "hour_cos"],
}


def ols_features(train: DataFrame, test: DataFrame, xs: list[str], y: str = "target") -> DataFrame:
    """One ordinary least squares fit on standardised features, applied to every test row."""
    coef = solve(gram(train, [], xs, y), standardize=True).select("coef")
    return beside(test, coef).withColumn("pred", linear_value(xs)).drop("coef")


def ols_per_mode(train: DataFrame, test: DataFrame, keys: list[str] | None = None, min_n: int = 1) -> DataFrame:
    """A separate fit per mode (and key), on the features that mode uses; without a fit the temperature stays."""
    keys = keys or []
    by = [*keys, "mode"]
    out = None
    for mode, xs in MODE_FEATURES.items():
        coef = solve(gram(train.where(F.col("mode") == mode), by, xs, "target"), standardize=True, min_n=min_n).drop("n")
        part = test.where(F.col("mode") == mode).join(coef, by, "left")
        part = part.withColumn("pred", F.coalesce(linear_value(xs), F.col("indoor"))).drop("coef")
        out = part if out is None else out.unionByName(part)
    return out


def ols_per_home(train: DataFrame, test: DataFrame, xs: list[str], min_n: int = 5) -> DataFrame:
    """One fit per home; a home without enough rows keeps its current temperature."""
    coef = solve(gram(train, ["home_id"], xs, "target"), standardize=True, min_n=min_n).drop("n")
    return test.join(coef, "home_id", "left").withColumn("pred", F.coalesce(linear_value(xs), F.col("indoor"))).drop("coef")


def ridge_with_homes(
    train: DataFrame, test: DataFrame, xs: list[str], y: str, alpha: float, home_alpha: float | None, min_n: int
) -> DataFrame:
    """Global fit, replaced by the home's own ridge where it has at least ``min_n`` rows."""
    levels = [(solve(gram(train, [], xs, y), alpha), [])]
    if home_alpha is not None:
        levels = [(solve(gram(train, ["home_id"], xs, y), home_alpha, min_n=min_n), ["home_id"]), *levels]
    none = F.lit(None).cast("array<double>")
    return lookup_with_fallback(test, levels, "coef", none, "coef").withColumn("fit", linear_value(xs)).drop("coef")


def drive_gap_regression(train: DataFrame, test: DataFrame, per_home: bool, min_n: int = 20) -> DataFrame:
    """15-minute change on (drive, gap): ordinary globally, ridge per home with a ridge global fallback."""

    def prep(d: DataFrame) -> DataFrame:
        return d.withColumns({"drive": F.col("outdoor_temp") - F.col("current_temp"), "dy": F.col("y_true") - F.col("current_temp")})

    train = prep(train).where(F.col("drive").isNotNull())
    test = prep(test).where(F.col("drive").isNotNull())
    scored = (
        ridge_with_homes(train, test, ["drive", "current_gap"], "dy", 1.0, 1.0, min_n)
        if per_home
        else ridge_with_homes(train, test, ["drive", "current_gap"], "dy", 0.0, None, 1)
    )
    return scored.withColumn("pred", F.col("current_temp") + F.col("fit")).drop("fit")


def time_to_target_ridge(train: DataFrame, test: DataFrame, per_home: bool, min_n: int = 30) -> DataFrame:
    """Remaining minutes on |gap| and drive (plus elapsed minutes per home), never below 0."""

    def prep(d: DataFrame) -> DataFrame:
        return d.withColumns({"gap": F.abs("current_gap"), "y": F.col("remaining_min").cast("double"), "el": F.col("elapsed_min").cast("double")})

    train, test = prep(train), prep(test)
    scored = (
        ridge_with_homes(train, test, ["gap", "outdoor_drive", "el"], "y", 1.0, 1.0, min_n)
        if per_home
        else ridge_with_homes(train, test, ["gap", "outdoor_drive"], "y", 1.0, None, 1)
    )
    return scored.withColumn("pred", F.greatest(F.lit(0.0), F.col("fit"))).drop("fit", "gap", "y", "el")


DRIFT_RIDGE_FEATURES = [
    "log_margin", "margin", "is_heating", "signed_outdoor_drive", "outdoor_temp", "start_temp", "boundary_temp",
    "hour_sin", "hour_cos", "month_sin", "month_cos",
]
ACTIVE_RIDGE_FEATURES = ["log_gap", "is_heating", "signed_outdoor_drive"]
NINE_EFFECTS = [*ACTIVE_RIDGE_FEATURES, "hour_sin", "hour_cos", "month_sin", "month_cos", "system_running", "outdoor_humidity"]


def ridge_plus_offsets(
    train: DataFrame, test: DataFrame, xs: list[str], keys: list[str] | None, lo: float | None = None, hi: float | None = None, min_n: int = 3
) -> DataFrame:
    """Global ridge on log minutes, then each key's shrunken mean residual, then exp."""
    coef = stage(solve(gram(train, [], xs, "log_duration"), 1.0).select("coef"), "ridge")  # one row, read by scores and residuals
    scored = beside(test, coef).withColumn("_log", linear_value(xs)).drop("coef")
    if keys:
        resid = beside(train, coef).select(*keys, (F.col("log_duration") - linear_value(xs)).alias("residual"))
        off = residual_offset(resid, keys, 10.0, min_n)
        scored = lookup_with_fallback(scored, [(off, keys)], "offset", F.lit(0.0), "_off")
    else:
        scored = scored.withColumn("_off", F.lit(0.0))
    pred = F.exp(F.col("_log") + F.col("_off"))
    return scored.withColumn("pred", clip(pred, lo, hi) if lo is not None else pred).drop("_log", "_off")


class NotConverged(RuntimeError):
    """The variances of a mixed model did not settle."""


def random_intercept(train: DataFrame, group: str, xs: list[str], y: str, iterations: int = 200, tol: float = 1e-5) -> tuple[np.ndarray, DataFrame]:
    """Linear model with a normal random intercept per group, fitted by expectation-maximisation until the variances
    change by less than the share ``tol``; an error where ``iterations`` do not suffice.

    Rows are reduced once to per-group sums. Each iteration is one aggregate over the group table; only
    the p by p totals reach the driver, whatever the number of groups.
    """
    p = len(xs) + 1
    stats = stage(gram(train.select(group, *xs, y), [group], xs, y), "group-sums")
    try:
        whole = stats.agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("g"),
            F.array(*[F.sum(F.col("s")[i]) for i in range(p)]).alias("s"),
            F.array(*[F.sum(F.col("p")[i]) for i in range(p * (p + 1) // 2)]).alias("p"),
        ).first()
        n, groups = float(whole.n), float(whole.g)
        mean, centred = unpack(n, np.array(whole.s), np.array(whole.p))
        # Full cross-products with a leading column of ones for the intercept.
        full = np.zeros((p + 1, p + 1))
        full[1:, 1:] = centred + n * np.outer(mean, mean)
        full[0, 0], full[0, 1:], full[1:, 0] = n, whole.s, whole.s
        sx, sxy, syy = full[:p, :p], full[:p, p], full[p, p]
        beta = np.linalg.lstsq(sx, sxy, rcond=1e-10)[0]
        sigma2 = max((syy - beta @ sxy) / n, 1e-9)
        tau2 = sigma2 / 2
        ones = F.array(F.col("n").cast("double"), *[F.col("s")[i] for i in range(p - 1)])
        sums = stats.select("n", ones.alias("o"), F.col("s")[p - 1].alias("sy"))
        def step(theta: np.ndarray) -> np.ndarray:
            """One round of expectation and maximisation: (log sigma2, log tau2, beta)."""
            s2, t2, b = float(np.exp(theta[0])), float(np.exp(theta[1])), theta[2:]
            resid = F.col("sy") - sum((F.col("o")[i] * float(b[i]) for i in range(p)), F.lit(0.0))
            w = F.lit(t2) / (F.lit(s2) + F.col("n") * F.lit(t2))
            tot = sums.withColumns({"u": w * resid, "v": w * F.lit(s2)}).agg(
                F.sum(F.col("u") * F.col("u") + F.col("v")).alias("uu"),
                F.sum(F.col("n") * (F.col("u") * F.col("u") + F.col("v"))).alias("nuu"),
                F.sum(F.col("u") * F.col("sy")).alias("uy"),
                F.array(*[F.sum(F.col("u") * F.col("o")[i]) for i in range(p)]).alias("ux"),
            ).first()
            ux = np.array(tot.ux)
            b = np.linalg.lstsq(sx, sxy - ux, rcond=1e-10)[0]
            sse = syy - 2 * b @ sxy + b @ sx @ b - 2 * tot.uy + 2 * b @ ux + tot.nuu
            return np.concatenate(([np.log(max(sse / n, 1e-9)), np.log(max(tot.uu / groups, 1e-9))], b))

        # Squared extrapolation (Varadhan and Roland 2008): two rounds give a step and its change; the round after steadies it.
        theta = np.concatenate(([np.log(sigma2), np.log(tau2)], beta))
        for _ in range(iterations):
            one = step(theta)
            if np.abs(one[:2] - theta[:2]).max() <= tol:
                theta = one
                break
            two = step(one)
            r, v = one[:2] - theta[:2], two[:2] - 2 * one[:2] + theta[:2]
            length = max(1.0, np.linalg.norm(r) / max(np.linalg.norm(v), 1e-300))
            jump = two.copy()
            jump[:2] = np.clip(theta[:2] + 2 * length * r + length * length * v, two[:2] - 3, two[:2] + 3)
            jump[:2] = np.maximum(jump[:2], np.log(1e-9))
            theta = step(jump)
        else:
            raise NotConverged(f"not converged after {iterations} rounds: variances {np.exp(theta[:2])}")
        sigma2, tau2, beta = float(np.exp(theta[0])), float(np.exp(theta[1])), theta[2:]
        resid = F.col("sy") - sum((F.col("o")[i] * float(beta[i]) for i in range(p)), F.lit(0.0))
        w = F.lit(float(tau2)) / (F.lit(float(sigma2)) + F.col("n") * F.lit(float(tau2)))
        offsets = stats.select(group, "n", ones.alias("o"), F.col("s")[p - 1].alias("sy")).select(group, "n", (w * resid).alias("offset"))
        # The offsets are a table of their own, so the sums can go.
        offsets = stage(offsets, "group-offsets")
    finally:
        unstage(stats)
    return beta, offsets


def predict_random_intercept(train: DataFrame, test: DataFrame, xs: list[str], y: str = "log_duration", mode: str = "is_heating", iterations: int = 200) -> DataFrame:
    """``pred`` and ``fit_by``: ``mixed``, or ``ridge`` where the mixed model cannot be fitted in ``iterations`` rounds.

    The fallback is the global ridge with shrunken mean residuals by home and mode, from three residuals on. Without training rows
    every offset and effect is missing and so is the prediction. ``y`` is in log minutes.
    """
    try:
        beta, offsets = random_intercept(train, "home_id", xs, y, iterations)
    except NotConverged:
        return ridge_plus_offsets(train, test, xs, ["home_id", mode]).withColumn("fit_by", F.lit("ridge"))
    fixed = F.lit(float(beta[0]))
    for b, x in zip(beta[1:], xs):
        fixed = fixed + F.lit(float(b)) * F.col(x)
    scored = lookup_with_fallback(test, [(offsets, ["home_id"])], "offset", F.lit(0.0), "_u")
    return scored.withColumn("pred", F.exp(fixed + F.col("_u"))).drop("_u").withColumn("fit_by", F.lit("mixed"))
