"""Classes of near-duplicate documents by banded MinHash, in DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import ascii_lower
from emberline.llm.components import components
from emberline.plans.staging import stage, unstage

WIDTH = 5  # words of a shingle


@dataclass(frozen=True)
class Bands:
    """Signatures of ``bands`` times ``rows`` minima; documents that agree in a whole band meet in a bucket."""

    bands: int = 14
    rows: int = 3

    @property
    def symbols(self) -> int:
        return self.bands * self.rows

    def miss(self, similarity: float) -> float:
        """Probability that a pair of that similarity meets nowhere."""
        return (1 - similarity**self.rows) ** self.bands

    def least(self, similarity: float, miss: float = 1e-6) -> int:
        """Equal minima that a pair of that similarity lacks with at most the probability ``miss``."""
        below = 0.0
        for k in range(self.symbols + 1):
            below += math.comb(self.symbols, k) * similarity**k * (1 - similarity) ** (self.symbols - k)
            if below > miss:
                return k
        return self.symbols


def _hashed(df: DataFrame, *keep: str) -> DataFrame:
    """``keep``, ``words``: a 64-bit hash each, and ``d1``, ``d2``: 128 bits of their sequence. A-Z in lower case, words between ASCII blanks; blank texts go."""
    rows = df.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*keep, F.split(ascii_lower(F.col("text")), r"[\x20\x09-\x0D]+").alias("w"))
    # Blanks at either end leave an empty word there.
    first = F.when(F.get("w", F.lit(0)) == "", 2).otherwise(1)
    last = F.size("w") - F.when(F.element_at("w", -1) == "", 1).otherwise(0)
    rows = rows.select(*keep, F.transform("w", lambda w: F.xxhash64(w)).alias("h"), first.alias("first"), last.alias("last"))
    rows = rows.select(*keep, F.slice("h", F.col("first"), F.col("last") - F.col("first") + 1).alias("words"))
    return rows.select(*keep, "words", F.xxhash64("words").alias("d1"), F.xxhash64(F.lit(1), "words").alias("d2"))


def _shingle(i: Column) -> Column:
    """Hash of the words from place ``i``; behind the last word nothing is added."""
    return F.xxhash64(*[F.get("words", i + k) for k in range(WIDTH)])


def _places() -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size("words") - WIDTH, F.lit(0)))


def _prefixes(held: DataFrame, percent: int) -> DataFrame:
    """Entries (s, id, component, size, most): every two sets of different components with the similarity share one's s, each within the other's ``most``.

    Shingles of one component only come first in every set, the others follow by the number of sets that have them. The first
    shingle two sets share has all else they share behind it in both, so only a set of ``most`` shingles or fewer can reach the
    similarity with what is left. Rarely shared shingles so stand for a set, and what all copies of a text have comes last.
    """
    exploded = held.select("id", "component", "size", F.explode("set").alias("s"))
    common = exploded.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("s", "n")
    ordered = exploded.join(common, "s").groupBy("id", "component", "size").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("shared"))
    ranked = ordered.select("id", "component", "size", F.size("shared").alias("all"), F.posexplode("shared").alias("place", "of"))
    most = F.floor((F.col("all") - F.col("place")) * (100 + percent) / percent) - F.col("size")
    entries = ranked.select("id", "component", "size", F.col("of.s").alias("s"), most.alias("most"))
    return stage(entries.filter(100 * F.col("most") >= percent * F.col("size")), "near-prefixes")


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shape: Bands | None = None, block_rows: int = 512) -> DataFrame:
    """(id, class) of every id whose text is not blank: the smallest id reachable over links, the smallest of an id's texts.

    Documents link when 100 * intersection >= ``percent`` * union of their sets of five-word shingles (all words of a shorter
    text). Only DataFrame functions run: 1. Texts of the same words are one class. Shingles are exploded as hashes and reduced
    in the map to the minima of ``shape``. 2. Classes that agree in a whole band meet in a bucket; each is held against the bucket's most central class
    first. 3. The classes of buckets that still hold several components meet again by those of their rarest shingles of which
    every linked pair shares one (``_prefixes``): each first with the most central class of the shingle, then with all of other
    components, in blocks of ``block_rows`` spread over tasks. So copies of one text that are too far from each other do not meet in
    pairs. Pairs with too few equal minima for the similarity are let go, all others are confirmed on whole sets. A pair just at
    the threshold is missed with ``shape.miss(percent / 100)``, plus 1e-6.
    """
    shape = shape or Bands()
    rows = df.select(F.col(f"`{id_col}`").alias("did"), F.col(f"`{text_col}`").cast("string").alias("text"))
    exploded = _hashed(rows, "did").select("did", "d1", "d2", "words", F.explode(_places()).alias("i")).select("did", "d1", "d2", _shingle(F.col("i")).alias("s"))
    minima = exploded.groupBy("did", "d1", "d2").agg(*[F.min(F.hash(F.lit(k), "s")).alias(f"m{k}") for k in range(shape.symbols)])
    signed = stage(minima.select("did", "d1", "d2", F.array(*[f"m{k}" for k in range(shape.symbols)]).alias("sig")), "near-signatures")
    classes = signed.groupBy("d1", "d2").agg(F.min("did").alias("first"), F.first("sig").alias("sig"))
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()), "near-classes")

    keys = [F.xxhash64(F.lit(b), *[F.get("sig", F.lit(b * shape.rows + k)) for k in range(shape.rows)]) for b in range(shape.bands)]
    entries = classes.select("id", F.explode(F.array(*keys)).alias("key"))
    shared = stage(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-shared")
    multi = stage(entries.join(shared, "key"), "near-entries")
    # The middle of a bucket: of its classes the one that shares most places with others over all its buckets.
    central = stage(multi.groupBy("id").agg(F.sum("n").alias("score")), "near-central")
    hubs = stage(multi.join(central, "id").groupBy("key").agg(F.max(F.struct("score", "id"))["id"].alias("hub")), "near-hubs")

    # Sets of all classes that share a bucket, once. An id that repeats with other texts is told apart by the words.
    wanted = classes.join(multi.select("id").distinct(), "id", "left_semi")
    asked = wanted.select("id", F.col("first").alias("_first"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"))
    # Written before the filter, which would else be pushed below and hash every text again.
    read = stage(_hashed(rows.join(asked, F.col("did").eqNullSafe(F.col("_first"))), "id", "_d1", "_d2"), "near-words")
    own = read.filter("d1 = _d1 and d2 = _d2").select("id", "words").dropDuplicates(["id"])
    sets = stage(own.select("id", F.array_distinct(F.transform(_places(), _shingle)).alias("set")), "near-sets")
    traits = stage(wanted.join(sets.select("id", F.size("set").alias("size")), "id").select("id", "sig", "size"), "near-traits")

    equal = sum((F.get("sig_a", F.lit(k)) == F.get("sig_b", F.lit(k))).cast("int") for k in range(shape.symbols))
    close = (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")) & (equal >= shape.least(percent / 100))
    stars = multi.join(hubs, "key").filter("id <> hub").select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()
    stars = stars.join(traits.toDF("a", "sig_a", "size_a"), "a").join(traits.toDF("b", "sig_b", "size_b"), "b")
    stars = stage(stars.filter(close).select("a", "b"), "near-stars")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        sides = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        both = F.size(F.array_intersect("set_a", "set_b"))
        return stage(sides.filter(both * (100 + percent) >= (F.size("set_a") + F.size("set_b")) * percent).select("a", "b"), name)

    links = confirmed(stars, "near-links")
    found = components(links)
    placed = stage(multi.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "near-placed")
    split = stage(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key"), "near-split")
    opened = stage(placed.join(split, "key").select("id", "component").distinct(), "near-open")
    prefixes = _prefixes(opened.join(sets.select("id", "set", F.size("set").alias("size")), "id"), percent)

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        """Links among ``pairs`` (id_x, id_y) that were not stars."""
        pairs = stage(pairs.select(F.greatest("id_x", "id_y").alias("a"), F.least("id_x", "id_y").alias("b")).distinct(), "near-pairs")
        fresh = pairs.join(stars, ["a", "b"], "left_anti").join(traits.toDF("a", "sig_a", "size_a"), "a").join(traits.toDF("b", "sig_b", "size_b"), "b")
        kept = stage(fresh.filter(close).select("a", "b"), "near-close")
        out = confirmed(kept, name)
        unstage(pairs, kept)
        return out

    # The middle of a shingle: of its sets the one with the fewest rarer shingles. What stands by it need not meet the others.
    middles = prefixes.groupBy("s").agg(F.max(F.struct((F.col("most") / F.col("size")).alias("rank"), F.col("id").alias("id_y"), F.col("component").alias("component_y"), F.col("size").alias("size_y"), F.col("most").alias("most_y"))).alias("y"))
    sides = [F.col(c).alias(f"{c}_x") for c in ("id", "component", "size", "most")]
    fit = (F.col("component_x") != F.col("component_y")) & (F.col("size_y") <= F.col("most_x")) & (F.col("size_x") <= F.col("most_y"))
    nearer = checked(prefixes.select("s", *sides).join(middles.select("s", "y.*"), "s").filter(fit), "near-nearer")
    found = components(links.union(nearer))
    entries = prefixes.join(found.withColumnRenamed("node", "id").withColumnRenamed("component", "joined"), "id", "left").withColumn("component", F.coalesce("joined", "id")).drop("joined")
    # Those in the component of the middle, copies of one text, are not held against each other.
    cores = entries.groupBy("s").agg(F.max(F.struct((F.col("most") / F.col("size")).alias("rank"), "component"))["component"].alias("core"))
    entries = stage(entries.join(cores, "s").withColumn("main", F.col("component") == F.col("core")).drop("core"), "near-entered")
    # Index: as the set of fewer shingles, by size. A frequent shingle's index is dealt to blocks, each with every probe in it.
    index = entries.filter("most >= size").select("s", F.col("main").alias("main_y"), *[F.col(c).alias(f"{c}_y") for c in ("size", "id", "component", "most")])
    listed = stage(index.groupBy("s", "main_y", "size_y").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")), "near-listed")
    x = entries.select("s", "main", *sides).join(listed, "s").filter("size_y <= least(size_x, most_x) and not (main and main_y)").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("main", "blocks")
    y = index.join(listed, ["s", "main_y", "size_y"]).withColumn("block", F.pmod(F.xxhash64("id_y"), F.col("blocks")).cast("int")).drop("blocks")
    once = (F.col("size_y") < F.col("size_x")) | (F.col("id_y") < F.col("id_x"))
    rest = checked(x.join(y, ["s", "main_y", "size_y", "block"]).filter(fit & once), "near-rest")
    final = components(links.union(nearer).union(rest))
    named = classes.select("id", "first", "d1", "d2").join(final.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = named.groupBy("component").agg(F.min("first").alias("class"))
    of = signed.select("did", "d1", "d2").join(named.join(lowest, "component").select("d1", "d2", "class"), ["d1", "d2"])
    out = stage(of.groupBy("did").agg(F.min("class").alias("class")), "near-ids")
    unstage(signed, classes, shared, multi, central, hubs, stars, read, sets, traits, links, placed, split, opened, prefixes, nearer, entries, listed, rest)
    return out.select(F.col("did").alias(id_col), "class")
