"""Load, comfort and cost indicators over run histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalar import TOU_PRICES, tou_price
from emberline.operators.joins import relative_to
from emberline.plans.lookup import beside
from emberline.plans.series import Series, epoch, null_safe_join


def par(load: DataFrame, by: list[str], value: str = "consumption_kw") -> DataFrame:
    """Peak over average; NULL when the average is 0."""
    return load.groupBy(*by).agg((F.max(value) / F.nullif(F.avg(value), F.lit(0.0))).alias("par"))


def day_blocks(load: DataFrame, by: list[str], step: str, block: int) -> DataFrame:
    """Rows numbered in step order and put in consecutive blocks (not calendar days)."""
    s = Series(load, by, [step], F.col(step).cast("double")).row_number("_rn")
    r0 = F.col("_rn") - 1
    return s.done().withColumns({"block": F.floor(r0 / block).cast("long"), "slot": (r0 % block).cast("long")}).drop("_rn")


def daily_par(load: DataFrame, by: list[str], step: str = "step", value: str = "consumption_kw", block: int = 24) -> DataFrame:
    """Mean of block-wise peak over average, over complete blocks with a positive mean; else the plain ratio."""
    return block_sums(load, by, step, value, block).groupBy(*by).agg(*daily_ratios(block))


def block_sums(load: DataFrame, by: list[str], step: str, value: str, block: int) -> DataFrame:
    return day_blocks(load, by, step, block).groupBy(*by, "block").agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("known"), F.max(value).alias("mx"), F.avg(value).alias("av"), F.sum(value).alias("sm")
    )


def daily_ratios(block: int) -> list[Column]:
    """Of blocks: how many are complete, and their mean peak over average."""
    full = F.col("n") == block
    n_days = F.count(F.when(full, 1))
    ratio = F.when(n_days == 0, F.max("mx") / (F.sum("sm") / F.sum("n"))).otherwise(F.avg(F.when(full & (F.col("av") > 0), F.col("mx") / F.col("av"))))
    return [n_days.alias("n_days"), ratio.alias("daily_par")]


def hourly_profile(load: DataFrame, by: list[str], step: str = "step", value: str = "consumption_kw", block: int = 24) -> DataFrame:
    """Mean and population deviation by slot over complete blocks."""
    b = day_blocks(load, by, step, block)
    # The window's key is one block.
    whole = b.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "block"))).where(F.col("_n") == block)
    return (
        whole.groupBy(*by, "slot")
        .agg(F.avg(value).alias("mean_kw"), F.stddev_pop(value).alias("std_kw"), F.count(F.lit(1)).alias("n_days"))
    )


def policy_kpis(history: DataFrame, by: list[str], prices: list[float] = TOU_PRICES, peak: tuple[int, int] = (17, 20)) -> DataFrame:
    """Energy, peak, comfort and cost per run.

    The step length is the distance of a run's first two rows (1 h if there is one row): two minima, nothing is
    sorted. All sums are plain and are scaled by it afterwards, so one aggregate serves everything.
    """
    place = F.struct(*[c for c in ("timestamp", "event_id") if c in history.columns])
    rows = null_safe_join(history, history.groupBy(*by).agg(F.min(place).alias("_first")), by)
    second = F.min(F.when(place > F.col("_first"), place))["timestamp"]
    power = F.col("hvac_power_kw")
    lower, upper = F.col("heat_setpoint") - 1.0, F.col("cool_setpoint") + 1.0
    t = F.col("indoor_temp")
    dev = F.when(t < lower, lower - t).when(t > upper, t - upper).otherwise(0.0)
    in_peak = (F.col("hour") >= peak[0]) & (F.col("hour") < peak[1])
    step = (F.unix_micros(second) - F.unix_micros(F.min("_first")["timestamp"])) / 3.6e9
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(step, F.lit(1.0)).alias("dt"),
        F.sum(power).alias("p"),
        F.max(power).alias("peak_kw"),
        F.avg(power).alias("m"),
        F.sum(F.when(in_peak, power).otherwise(0.0)).alias("pp"),
        F.count(F.when((t < lower) | (t > upper), 1)).alias("oob"),
        F.sum(dev).alias("dd"),
        F.max(dev).alias("max_temp_deviation_f"),
        F.sum(power * tou_price("hour", prices)).alias("c"),
    )
    dt = F.col("dt")
    return sums.select(
        *by,
        (F.col("p") * dt).alias("total_kwh"),
        "peak_kw",
        F.when(F.col("m") > 0, F.col("peak_kw") / F.col("m")).otherwise(0.0).alias("par"),
        (F.col("pp") * dt).alias("peak_kwh"),
        (F.col("oob") * dt).alias("comfort_violations_h"),
        (F.col("dd") * dt).alias("discomfort_degree_hours"),
        "max_temp_deviation_f",
        (F.col("c") * dt).alias("cost_usd"),
    )


def savings_vs_reference(kpis: DataFrame, reference: str, keys: list[str], policy: str = "policy") -> DataFrame:
    ref = kpis.where(F.col(policy) == reference)
    return relative_to(kpis, ref, keys, {"peak_kwh": "shifted_kwh", "cost_usd": "cost_savings_usd"})


def controller_summary(load: DataFrame, kpis: DataFrame, names: list[str], by: str = "run") -> DataFrame:
    """One row per controller: ratios, total, peak, mean and selected named indicator values."""
    # Everything adds up from the day blocks, so the load is read and ordered once.
    mean = F.sum("sm") / F.sum("known")
    base = block_sums(load, [by], "step", "consumption_kw", 24).groupBy(by).agg(
        F.sum("sm").alias("total_kwh"), F.max("mx").alias("peak_kw"), mean.alias("mean_kw"), (F.max("mx") / F.nullif(mean, F.lit(0.0))).alias("par"), daily_ratios(24)[1]
    )
    picked = kpis.groupBy(by).agg(*[F.max(F.when(F.col("cost_function") == n, F.col("value"))).alias(n) for n in names])
    return base.join(picked, by, "left")


def sanity_checks(load: DataFrame, baseline: str, by: str = "run") -> DataFrame:
    """Energy ratio, sign, NaN and temperature checks per run as rows; temperature appears only on failure.

    Without the baseline run, as in the source, one failed check of its existence is the whole report.
    """
    v = F.col("consumption_kw")
    clean = F.nanvl(v, F.lit(None).cast("double"))
    g = load.groupBy(by).agg(
        F.sum(v).alias("e"),
        F.min(clean).alias("mn"),
        F.max(clean).alias("mx"),
        F.avg(clean).alias("av"),
        F.max(F.isnan(v) | v.isNull()).alias("has_nan"),
        F.min("temp_c").alias("t0"),
        F.max("temp_c").alias("t1"),
    )
    base = g.where(F.col(by) == baseline).select(F.col("e").alias("_b"), F.lit(True).alias("_found"))
    known = load.select(F.lit(baseline).alias(by)).limit(1)
    ratio = F.when(F.col("_b") > 0, F.col("e") / F.col("_b"))

    def check(name: str, passed: Column, message: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), passed.alias("passed"), message.alias("message"))

    def text(c: Column, digits: int) -> Column:
        return F.format_string(f"%.{digits}f", c)

    bounds_ok = (F.col("t0") >= 5) & (F.col("t1") <= 35)
    rows = F.array(
        F.when(ratio.isNotNull(), check("Energy ratio", ratio.between(0.5, 2.0), text(ratio, 3))),
        check("Non-negative consumption", F.col("mn") >= 0, F.concat(F.lit("min="), text(F.col("mn"), 2))),
        F.when(
            ~bounds_ok,
            check("Temp bounds", F.lit(False), F.concat(F.lit("["), text(F.col("t0"), 1), F.lit(", "), text(F.col("t1"), 1), F.lit("]"))),
        ),
        check("No NaN in consumption", ~F.col("has_nan"), F.lit("")),
        check(
            "Consumption stats",
            F.lit(True),
            F.concat(F.lit("mean="), text(F.col("av"), 1), F.lit(", max="), text(F.col("mx"), 1), F.lit(" kW")),
        ),
    )
    report = beside(g, base).where("_found").select(by, F.inline(F.filter(rows, lambda r: r.isNotNull())))
    # Name and message of the check that the source makes first.
    absent = check("Baseline exists", F.lit(False), F.lit("No baseline results"))
    missing = beside(known, base).where("_found is null").select(by, F.inline(F.array(absent)))
    return report.unionByName(missing)


def peak_day_kpis(history: DataFrame, by: list[str], peak: tuple[int, int] = (17, 20), lead_hours: int = 2, max_step_min: float = 60.0) -> DataFrame:
    """Per run and day: run time in and before the peak window, energy in it and in all, and minutes and degree-minutes out of comfort.

    A reading holds until the next one of its run, at most ``max_step_min``; the last holds for no time. Its interval is cut at midnight and
    at the window's borders, and minutes and energy are apportioned to the parts, so an interval over midnight or over a border counts on
    both sides. Days without readings have no row. Readings without time are left out; missing power is none.
    """
    micros = 60_000_000
    s = Series(history.where(F.col("timestamp").isNotNull()), by, [c for c in ("timestamp", "event_id") if c in history.columns], epoch("timestamp"))
    s.shift({"_next": (F.unix_micros("timestamp"), -1)})
    start = F.unix_micros("timestamp")
    rows = s.done().withColumns({"_a": start, "_b": F.least(F.coalesce("_next", start), start + F.lit(int(max_step_min * micros)))})
    day = 86_400 * 1_000_000
    first, last = F.floor(F.col("_a") / day), F.floor(F.greatest(F.col("_b") - 1, F.col("_a")) / day)
    parts = rows.withColumn("_day", F.explode(F.sequence(first.cast("long"), last.cast("long"))))

    def minutes(low, high) -> Column:
        """Of the interval, between two offsets of the day in microseconds."""
        inside = F.least(F.col("_b"), F.col("_day") * day + high) - F.greatest(F.col("_a"), F.col("_day") * day + low)
        return F.greatest(inside, F.lit(0)) / F.lit(float(micros))

    hour = 3_600 * 1_000_000
    power = F.coalesce(F.col("hvac_power_kw"), F.lit(0.0))
    t, lower, upper = F.col("indoor_temp"), F.col("heat_setpoint") - 1.0, F.col("cool_setpoint") + 1.0
    deviation = F.coalesce(F.when(t < lower, lower - t).when(t > upper, t - upper), F.lit(0.0))
    parts = parts.withColumns({"_all": minutes(0, day), "_peak": minutes(peak[0] * hour, peak[1] * hour), "_lead": minutes((peak[0] - lead_hours) * hour, peak[0] * hour), "_on": (power > 0).cast("double"), "_kw": power, "_dev": deviation})
    return parts.groupBy(*by, F.date_from_unix_date(F.col("_day").cast("int")).alias("day")).agg(
        F.sum(F.col("_on") * F.col("_peak")).alias("peak_runtime_min"),
        F.sum(F.col("_on") * F.col("_lead")).alias("pre_peak_runtime_min"),
        F.sum(F.col("_kw") * F.col("_peak") / 60).alias("peak_energy_kwh"),
        F.sum(F.col("_kw") * F.col("_all") / 60).alias("total_energy_kwh"),
        F.sum(F.when(F.col("_dev") > 0, F.col("_all")).otherwise(0.0)).alias("violation_min"),
        F.sum(F.col("_dev") * F.col("_all")).alias("violation_degree_min"),
        F.max("_dev").alias("max_violation_f"),
    )


def with_reference_day(kpis: DataFrame, reference: str, keys: list[str], policy: str = "policy") -> DataFrame:
    """Adds percent less peak run time and percent more energy than the reference policy on the same day; null where it has none."""
    ref = kpis.where(F.col(policy) == reference).select(*keys, F.col("peak_runtime_min").alias("_run"), F.col("total_energy_kwh").alias("_kwh"))
    out = null_safe_join(kpis, ref, keys)
    less = 100 * (F.col("_run") - F.col("peak_runtime_min")) / F.nullif("_run", F.lit(0.0))
    more = 100 * (F.col("total_energy_kwh") - F.col("_kwh")) / F.nullif("_kwh", F.lit(0.0))
    return out.withColumns({"peak_runtime_reduction_pct": less, "energy_overhead_pct": more}).drop("_run", "_kwh")
