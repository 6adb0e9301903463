"""Mixing of sources by temperature, as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import digest128, free_name, text_or_empty
from emberline.plans.staging import stage

ROUNDS = 60  # halvings of [0, 1]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(tokens: list[int], exponent: float) -> list[float]:
    """Normalised weights: token shares to the power of ``exponent`` (1: as they are, 0: all equal)."""
    total = sum(tokens)
    powers = [(t / total) ** exponent for t in tokens]
    return [p / sum(powers) for p in powers]


def bisect(tokens: list[int], holds, largest: bool) -> float:
    """Largest (or smallest) exponent in [0, 1] whose weights satisfy ``holds``, which is monotone in the exponent."""
    low, high = 0.0, 1.0
    if largest and holds(tempered(tokens, 1.0)):
        return 1.0
    if not largest and holds(tempered(tokens, 0.0)):
        return 0.0
    for _ in range(ROUNDS):
        mid = (low + high) / 2
        if holds(tempered(tokens, mid)) == largest:
            low = mid
        else:
            high = mid
    return low if largest else high


@dataclass(frozen=True)
class Mix:
    exponent: float
    weights: list[float]
    budgets: list[int]


def plan_mix(tokens: list[int], target_entropy: float | None, max_repeats: float | None, budget: int | None) -> Mix:
    """Exponent, weights and token budget of each source.

    The largest exponent whose entropy reaches ``target_entropy`` (a share of that of equal weights), raised where needed
    to the smallest one at which no source repeats more than ``max_repeats`` times. Without a total ``budget`` it is the
    smallest one that uses every document once.
    """
    repeats = lambda w: [x * (budget or max(t / y for t, y in zip(tokens, w, strict=True))) / t for x, t in zip(w, tokens, strict=True)]
    exponent = 1.0
    if target_entropy is not None:
        exponent = bisect(tokens, lambda w: entropy(w) >= target_entropy * math.log(len(tokens)) - 1e-12, True)
    if max_repeats is not None:
        exponent = max(exponent, bisect(tokens, lambda w: max(repeats(w)) <= max_repeats, False)) if target_entropy is not None else bisect(tokens, lambda w: max(repeats(w)) <= max_repeats, False)
    weights = tempered(tokens, exponent)
    return Mix(exponent, weights, [round(r * t) for r, t in zip(repeats(weights), tokens, strict=True)])


def word_count(text: Column) -> Column:
    """Words between ASCII blanks."""
    return F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def mix_schedule(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float | None = None,
    max_repeats: float | None = 2.0,
    budget: int | None = None,
    block_tokens: int = 1 << 20,
    seed: int = 3,
    max_sources: int = 100_000,
) -> DataFrame:
    """One row per use of a document: key, id, source, tokens, pass, block, slot, weight.

    Tokens of a document are its words and one end. Token sums per source (the only thing sent to the driver, at most
    ``max_sources`` numbers) give the weights, see ``plan_mix``. Each pass over a source is a seeded permutation of its
    documents; passes follow until its budget is used, the last one as far as whole documents fit. A use's place in its source,
    as a share of the budget, gives its block, so each block of about ``block_tokens`` holds every source at its weight;
    within a block a second hash permutes. Running sums go over buckets of the permutation, some 65,536 documents each, so a hot source
    is many tasks.

    Rows that repeat id and text share one entry (``key`` is the digest of both). Null source is a source of its own,
    null text has one token, null ids are ids like others. An empty table gives no rows.
    """
    spark = df.sparkSession
    text, ident = text_or_empty(f"`{text_col}`"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    rows = df.select(
        digest128(F.concat_ws("\n", ident, text)).alias("key"), F.col(f"`{id_col}`").alias("id"), ident.alias("ident"), F.col(f"`{source_col}`").cast("string").alias("source"), (word_count(text) + 1).alias("tokens")
    )
    rows = stage(rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("id", "ident")], F.min("source").alias("source"), F.first("tokens").alias("tokens")), "mix-rows")
    sums = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sums.sort(key=lambda r: (r["source"] is not None, r["source"]))
    tokens = [r["tokens"] for r in sums]
    mix = plan_mix(tokens, target_entropy, max_repeats, budget) if tokens else Mix(1.0, [], [])
    blocks = max(1, -(-sum(mix.budgets) // block_tokens))
    plan = [(r["source"], r["tokens"], b, w, 1 << max(3, (r["n"] >> 16).bit_length())) for r, b, w in zip(sums, mix.budgets, mix.weights, strict=True)]
    plan = spark.createDataFrame(plan, "plan_source string, total long, budget long, weight double, buckets int")
    uses = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("pass", F.explode(F.sequence(F.lit(0), F.ceil(F.col("budget") / F.col("total")).cast("int"))))
    uses = uses.filter(F.col("pass") * F.col("total") < F.col("budget"))
    uses = uses.withColumn("order", F.md5(F.concat_ws("|", F.lit(seed), "pass", "ident", F.hex("key"))))
    uses = uses.withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.col("buckets") / (1 << 32)).cast("int"))
    group = ["source", "pass", "bucket"]
    ahead = uses.groupBy(*group).agg(F.sum("tokens").alias("own"))
    ahead = ahead.select(*group, (F.sum("own").over(Window.partitionBy("source", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")).alias("ahead"))
    ahead = ahead.select(*[F.col(c).alias(f"_{c}") for c in group], "ahead")
    within = Window.partitionBy(*group).orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    placed = uses.withColumn("end", F.sum("tokens").over(within)).join(ahead, F.col("source").eqNullSafe(F.col("_source")) & (F.col("pass") == F.col("_pass")) & (F.col("bucket") == F.col("_bucket")))
    placed = placed.withColumn("end", F.col("end") + F.col("ahead") + F.col("pass") * F.col("total")).filter(F.col("end") <= F.col("budget"))
    placed = placed.withColumn("block", F.floor((F.col("end") - F.col("tokens")).cast("double") * blocks / F.col("budget")).cast("long"))
    slot = Window.partitionBy("block").orderBy(F.md5(F.concat_ws("|", F.lit("slot"), F.lit(seed), "pass", "ident", F.hex("key"))))
    return placed.select("key", F.col("id").alias(id_col), "source", "tokens", "pass", "block", (F.row_number().over(slot) - 1).cast("long").alias("slot"), "weight")


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The rows of ``df``, each as often as its source's budget uses it, with ``pass``, ``block`` and ``slot`` (replaced in the input)."""
    key = free_name(df, "_key")
    uses = mix_schedule(df, id_col, text_col, source_col, **settings).select(F.col("key").alias(key), "pass", "block", "slot")
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    rows = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in ("pass", "block", "slot")], digest128(F.concat_ws("\n", ident, text_or_empty(f"`{text_col}`"))).alias(key))
    return rows.join(uses, key).drop(key)
