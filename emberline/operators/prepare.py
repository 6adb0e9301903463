"""Filling, scaling and holding out readings before a model sees them, and how readings change over several horizons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalar import comfort_mode
from emberline.plans.lookup import beside
from emberline.plans.quantiles import agg_with_quantiles
from emberline.plans.series import identity, null_safe_join, telemetry_series

# Share of missing readings that flags a home, and run-time seconds in a five-minute step.
MISSING_SHARE, STEP_SECONDS = 0.1, 300.0


def fill_gaps(t: DataFrame, columns: list[str], max_gap_min: float = 30.0) -> DataFrame:
    """Missing values between two readings at most ``max_gap_min`` apart become values on the line between them; ``<column>_filled`` tells which.

    Longer gaps, and those before the first and after the last reading of a home, stay. Readings of one instant follow their event id; between two of
    them the earlier value holds. All columns share one order; other columns pass through.
    """
    s = telemetry_series(t)

    def reading(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.unix_micros("ts").alias("t"), F.col(c).alias("v")))

    s.last_seen({f"_p_{c}": reading(c) for c in columns})
    s.next_seen({f"_n_{c}": reading(c) for c in columns})
    new = {}
    for c in columns:
        p, n, now = F.col(f"_p_{c}"), F.col(f"_n_{c}"), F.unix_micros("ts")
        span = n["t"] - p["t"]
        line = F.when(span > 0, p["v"] + (n["v"] - p["v"]) * ((now - p["t"]) / span)).otherwise(p["v"])
        short = F.coalesce(F.col(c).isNull() & (span <= F.lit(int(max_gap_min * 60_000_000))), F.lit(False))
        new |= {c: F.when(short, line).otherwise(F.col(c)), f"{c}_filled": short}
    return s.done().withColumns(new).drop(*[f"_{x}_{c}" for c in columns for x in "pn"])


def missing_share(t: DataFrame, columns: list[str], most: float = MISSING_SHARE) -> DataFrame:
    """Per home the share of missing values of each column, and ``flagged`` where one is above ``most``. One aggregate."""
    shares = t.groupBy("home_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_missing") for c in columns])
    return shares.withColumn("flagged", F.greatest(*[F.col(f"{c}_missing") for c in columns], F.lit(0.0)) > most)


def fit_scales(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of each column over the rows given, to be saved as a table and applied to any rows."""
    return train.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def apply_scales(df: DataFrame, scales: DataFrame, columns: list[str]) -> DataFrame:
    """``<column>_z`` for each column; a column that never varied where it was fitted becomes 0, a missing value stays missing."""
    out = beside(df, scales.select(*[F.col(f"{c}_{n}").alias(f"_{c}_{n}") for c in columns for n in ("mean", "std")]))
    z = {f"{c}_z": F.when(F.col(f"_{c}_std") > 0, (F.col(c) - F.col(f"_{c}_mean")) / F.col(f"_{c}_std")).when(F.col(c).isNotNull() & F.col(f"_{c}_std").isNotNull(), 0.0) for c in columns}
    return out.withColumns(z).drop(*[f"_{c}_{n}" for c in columns for n in ("mean", "std")])


def runtime_share(column: str) -> Column:
    """Run time as a share of the step, missing as none."""
    return F.least(F.greatest(F.coalesce(F.col(column), F.lit(0.0)) / STEP_SECONDS, F.lit(0.0)), F.lit(1.0))


def holdout_cells(t: DataFrame, homes: DataFrame, first_held_month: int, train: str = "train") -> DataFrame:
    """Rows with their ``cell``: ``seen`` (training homes before the first held month), ``new_time``, ``new_home`` or ``new_both``.

    ``homes`` has one split per home; homes without one are new. Both sides depend on the home and month alone, so a home-month lies in one cell.
    """
    known = null_safe_join(t, homes.select("home_id", F.col("split").alias("_split")), ["home_id"])
    late, new = F.col("month") >= first_held_month, ~F.coalesce(F.col("_split") == train, F.lit(False))
    cell = F.when(late & new, "new_both").when(late, "new_time").when(new, "new_home").otherwise("seen")
    return known.withColumn("cell", cell).drop("_split")


def leak_check(cells: DataFrame) -> DataFrame:
    """(rule, n): home-months in two cells, homes seen that are also new, and months seen that are also held. All must be 0."""
    pairs = cells.select("home_id", "month", "cell").distinct()
    seen_home, seen_time = F.col("cell").isin("seen", "new_time"), F.col("cell").isin("seen", "new_home")

    def both(key: list[str], side: Column | None, rule: str) -> DataFrame:
        n = F.count_distinct("cell") if side is None else F.count_distinct(side)
        return pairs.groupBy(*key).agg(n.alias("k")).agg(F.lit(rule).alias("rule"), F.count_if(F.col("k") > 1).alias("n"))

    return both(["home_id", "month"], None, "home-month in two cells").unionByName(both(["home_id"], seen_home, "home seen and new")).unionByName(both(["month"], seen_time, "month seen and held"))


def change_by_horizon(t: DataFrame, horizons: dict[str, int], small: float = 0.5) -> DataFrame:
    """Change of the indoor temperature by horizon and mode at the start: n, mean, std, 5th and 95th percentile, and percent smaller than ``small``.

    ``horizons``: {name: rows ahead}. All are leads in one order of the readings, and all cells' percentiles come from one pass over
    their rows. Rows without mode, and pairs with a missing reading, are left out.
    """
    s = telemetry_series(t.select(*identity(t), "indoor", comfort_mode().alias("mode")))
    s.shift({f"_{k}": (F.col("indoor"), -n) for k, n in horizons.items()})
    pairs = F.inline(F.array(*[F.struct(F.lit(k).alias("horizon"), (F.col(f"_{k}") - F.col("indoor")).alias("change")) for k in horizons]))
    rows = s.done().where(F.col("mode") != "invalid").select("mode", pairs).where("change IS NOT NULL")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("change").alias("mean"), F.stddev_pop("change").alias("std"), (F.avg((F.abs("change") < small).cast("double")) * 100).alias("small_pct")]
    return agg_with_quantiles(rows, ["horizon", "mode"], aggs, F.col("change"), {"p5": 0.05, "p95": 0.95})
