"""Paired comparisons by stratum: bootstrap intervals, and signed-rank tests with a correction for their number."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.plans.quantiles import agg_with_quantiles
from emberline.plans.series import Series, null_safe_join

PRIME = (1 << 31) - 1
# Shares of a Poisson variable of mean one that are at most 0, 1, ..., 12.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])


def paired_differences(df: DataFrame, reference: Column, keys: list[str], measure: str) -> DataFrame:
    """Rows of ``df`` that are no reference, with ``diff``: the reference of the same ``keys`` less their own ``measure``.

    Rows without reference and missing measures go. The keys must name one reference row each.
    """
    ref = df.where(reference).select(*[F.col(k).alias(f"_ref_{k}") for k in keys], F.col(measure).alias("_ref"))
    own = df.where(~F.coalesce(reference, F.lit(False)))
    joined = own.join(ref, [F.col(k).eqNullSafe(F.col(f"_ref_{k}")) for k in keys])
    diff = (F.col("_ref") - F.col(measure)).cast("double")
    return joined.withColumn("diff", F.nanvl(diff, F.lit(None).cast("double"))).where("diff IS NOT NULL").drop("_ref", *[f"_ref_{k}" for k in keys])


def multipliers(resamples: int, seed: int) -> np.ndarray:
    """Two numbers below the prime for each resample, from digests."""
    return np.array([[int(hashlib.md5(f"{seed}:{b}:{x}".encode()).hexdigest()[:7], 16) + 1 for x in "ac"] for b in range(resamples)], np.int64)


def bootstrap_mean(df: DataFrame, strata: list[str], unit: Column, value: str = "diff", resamples: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """n, mean, median, quartiles and a percentile bootstrap interval of the mean, by stratum.

    A row's multiplicity in each resample is Poisson with mean one and follows from a hash of ``unit`` (any column that tells rows apart) and the
    resample: it is the same wherever the row lies. Each task adds its rows up to one sum per stratum and resample, so rows are neither copied
    nor shuffled. A resample without rows has no mean. Null strata are strata; null and NaN values are left out. Rows of equal ``unit`` are drawn together.
    """
    pairs = multipliers(resamples, seed)
    kinds = [df.schema[c] for c in strata]
    usable = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = usable.select(*strata, (F.conv(F.substring(F.md5(unit.cast("string")), 1, 7), 16, 10).cast("long")).alias("_h"), F.col(value).cast("double").alias("_v"))

    def summed(batches):
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(*[table.column(c).to_pylist() for c in range(len(strata))], strict=True)) if strata else [()] * batch.num_rows
            h, v = (table.column(len(strata) + k).to_numpy() for k in range(2))
            groups: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                groups.setdefault(k, []).append(i)
            for k, at in groups.items():
                total = totals.setdefault(k, np.zeros((resamples, 2)))
                for part in np.array_split(np.array(at), len(at) // 4096 + 1):
                    u = (h[part][:, None] * pairs[:, 0] + pairs[:, 1]) % PRIME / PRIME
                    times = np.searchsorted(POISSON, u, side="right")
                    total[:, 0] += times.T @ v[part]
                    total[:, 1] += times.sum(0)
        for k, total in totals.items():
            values = [pa.array([x] * resamples, f.type) for x, f in zip(k, batch.schema, strict=False)]
            yield pa.RecordBatch.from_arrays([*values, pa.array(range(resamples), pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], [*strata, "b", "s", "w"])

    schema = T.StructType([*kinds, *T._parse_datatype_string("b int, s double, w double").fields])
    means = rows.mapInArrow(summed, schema).groupBy(*strata, "b").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    tail = (1 - level) / 2
    # As many values as resamples in each stratum.
    bounds = means.groupBy(*strata).agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("_ci")).select(*strata, F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(F.col(value).cast("double")).alias("mean")]
    basis = agg_with_quantiles(usable, strata, aggs, F.col(value), {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return null_safe_join(basis, bounds, strata)


def normal_tail(z: Column) -> Column:
    """Chance that a standard normal value exceeds z >= 0, to 1e-7 (a polynomial in 1 / (1 + 0.2316419 z))."""
    # Coefficients of the approximation.
    a = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    t = 1 / (1 + F.lit(0.2316419) * z)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = t * (F.lit(c) + poly)
    return F.exp(-z * z / 2) / F.lit(math.sqrt(2 * math.pi)) * poly


def signed_rank(df: DataFrame, strata: list[str], value: str = "diff") -> DataFrame:
    """Signed-rank test by stratum against a median of zero, with two-sided p-values and Holm's correction over the strata.

    Zeros are left out. Equal sizes share the mean of their ranks: ranks are running counts over the distinct sizes of a stratum
    (in chunks where one stratum has very many, see ``Series``), never over its rows in one task. z has the tie correction
    and a continuity correction of one half; p is the normal approximation. A stratum without nonzero values has p = 1. Null
    strata are strata; null and NaN values are left out.
    """
    v = F.col(value).cast("double")
    usable = df.where(v.isNotNull() & ~F.isnan(v))
    sizes = usable.where(v != 0).groupBy(*strata, F.abs(v).alias("_size")).agg(F.count(F.lit(1)).alias("_t"), F.count_if(v > 0).alias("_up"))
    s = Series(sizes, strata, ["_size"], F.col("_size")).cumsum({"_end": F.col("_t")})
    rank = F.col("_end") - (F.col("_t") - 1) / 2
    sums = s.done().groupBy(*strata).agg(F.sum("_t").alias("n_nonzero"), F.sum(rank * F.col("_up")).alias("w_plus"), F.sum(F.col("_t").cast("double") ** 3 - F.col("_t")).alias("_ties"))
    out = null_safe_join(usable.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")), sums, strata)
    out = out.withColumns({"n_nonzero": F.coalesce("n_nonzero", F.lit(0)), "w_plus": F.coalesce("w_plus", F.lit(0.0))})
    n = F.col("n_nonzero").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.coalesce(F.col("_ties"), F.lit(0.0)) / 48)
    off = F.col("w_plus") - n * (n + 1) / 4
    z = F.when(spread > 0, F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)) / spread).otherwise(0.0)
    out = out.withColumn("z", z).withColumn("p_value", F.least(2 * normal_tail(F.abs("z")), F.lit(1.0)))
    return holm(out.drop("_ties"), strata)


def holm(tests: DataFrame, order: list[str], p: str = "p_value") -> DataFrame:
    """``p_holm``: step-down adjusted p-values over all rows of a table with one row per test; equal p-values follow ``order``."""
    places = Window.orderBy(F.col(p), *[F.col(c).asc_nulls_first() for c in order])
    ranked = tests.withColumns({"_k": F.row_number().over(places), "_m": F.count(F.lit(1)).over(Window.partitionBy())})
    scaled = F.least((F.col("_m") - F.col("_k") + 1) * F.col(p), F.lit(1.0))
    return ranked.withColumn("p_holm", F.max(scaled).over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))).drop("_k", "_m")
