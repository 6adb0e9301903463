"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import free_name, replacing
from emberline.plans.staging import stage, unstage


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """Good ones among ``n`` drawn without replacement, by inversion outwards from the mode; for any sizes."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    comb = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    up = down = math.exp(comb(good, mode) + comb(bad, n - mode) - comb(good + bad, n))
    left, a, b = rng.random() - up, mode, mode
    while left > 0 and (a < high or b > low):
        if a < high:
            up *= (good - a) * (n - a) / ((a + 1) * (bad - n + a + 1))
            a += 1
            left -= up
            if left <= 0:
                return a
        if b > low:
            down *= b * (bad - n + b) / ((good - b + 1) * (n - b + 1))
            b -= 1
            left -= down
            if left <= 0:
                return b
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows each source block sends to each shard: row sums ``counts``, column sums ``sizes``, as in a uniform permutation."""
    rng, left, out = random.Random(seed), list(sizes), []
    for n in counts:
        rest, row = sum(left), []
        for j, size in enumerate(left):
            rest -= size
            k = hypergeometric(rng, size, rest, n) if rest else n
            row.append(k)
            n -= k
            left[j] -= k
        out.append(row)
    return out


def shuffle_into_shards(df: DataFrame, shards: int = 40, seed: int = 11, block_rows: int = 1 << 18) -> DataFrame:
    """All columns of ``df`` with ``shard`` (sizes at most one apart) and ``slot`` (0, 1, ... in each shard).

    1. The rows are written with their place, so later jobs and retried tasks see the same source blocks: each input
       partition, cut every ``block_rows`` rows. 2. Block sizes go to the driver, one number per block, and the matrix
       of exact block-to-shard counts is drawn there (blocks x shards numbers). 3. Each block permutes its rows by a seeded
       hash of their place; ranks below the matrix row's running sums choose the shard. 4. Within a shard a second
       hash permutes again: buckets of it are ranked apart and offset by the buckets before, so no task holds a shard.

    Every row counts, repeated and null ones too: blocks are cut by place, not by a key, so no value can be hot. An empty table gives no rows.
    Input columns named ``shard`` or ``slot`` are replaced.
    """
    spark = df.sparkSession
    place, part, block, rank, bounds, bucket, offset = (free_name(df, f"_{x}") for x in ("place", "part", "block", "rank", "bounds", "bucket", "offset"))
    rows = stage(replacing(df, {place: F.monotonically_increasing_id()}), "shard-rows")
    blocks = rows.select("*", F.shiftright(place, 33).alias(part), F.floor((F.col(place) % (1 << 33)) / block_rows).alias(block))
    counts = sorted(tuple(r) for r in blocks.groupBy(part, block).count().collect())
    n = sum(c for _, _, c in counts)
    sizes = [n // shards + (j < n % shards) for j in range(shards)]
    matrix = communication_matrix([c for _, _, c in counts], sizes, seed)
    running = [[sum(row[: j + 1]) for j in range(shards)] for row in matrix]
    sent = spark.createDataFrame([(p, b, r) for (p, b, _), r in zip(counts, running, strict=True)], f"`{part}` long, `{block}` long, `{bounds}` array<long>")
    first = Window.partitionBy(part, block).orderBy(F.xxhash64(F.lit(seed), place), place)
    ranked = blocks.withColumn(rank, F.row_number().over(first) - 1).join(sent, [part, block])
    n_buckets = max(8, -(-n // (shards * block_rows)))
    second = F.xxhash64(F.lit(seed + 1), place)
    dealt = stage(
        replacing(
            ranked,
            {
                "shard": F.size(F.filter(bounds, lambda x: x <= F.col(rank))),
                bucket: F.pmod(F.shiftright(second, 20), F.lit(n_buckets)),
            },
        ).drop(part, block, rank, bounds),
        "shard-dealt",
    )
    unstage(rows)
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    ahead = dealt.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias(offset)).select("shard", bucket, (F.sum(offset).over(before) - F.col(offset)).alias(offset))
    own = Window.partitionBy("shard", bucket).orderBy(second, place)
    out = dealt.withColumn(rank, F.row_number().over(own) - 1).join(ahead, ["shard", bucket])
    return replacing(out, {"slot": (F.col(rank) + F.col(offset)).cast("long")}).select(*[f"`{c}`" for c in df.columns if c.lower() not in ("shard", "slot")], "shard", "slot")
