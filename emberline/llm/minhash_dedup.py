"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.components import compared, components
from emberline.plans.staging import stage, unstage
from emberline.session import ship_package

WIDTH = 5  # words of a shingle
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Index:
    """Signatures of ``symbols`` low bytes of minima, cut into ``chunks``.

    Two signatures that differ in at most ``radius`` = 2 * chunks - 1 symbols have a chunk that differs in at most one: were
    each to differ in two or more, they would differ in 2 * chunks. So a document is entered once per chunk and symbol of it, with that
    symbol left out, and every pair within the radius meets in a bucket.
    """

    symbols: int = 64
    chunks: int = 11

    @property
    def radius(self) -> int:
        return 2 * self.chunks - 1

    def bounds(self) -> list[tuple[int, int]]:
        cut = [round(k * self.symbols / self.chunks) for k in range(self.chunks + 1)]
        return list(zip(cut, cut[1:], strict=False))

    def miss(self, similarity: float) -> float:
        """Probability that a pair of that similarity lies outside the radius."""
        p = (1 - similarity) * (1 - 2**-8)
        return sum(math.comb(self.symbols, d) * p**d * (1 - p) ** (self.symbols - d) for d in range(self.radius + 1, self.symbols + 1))

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """A bucket for every chunk and left-out symbol: rows x symbols."""
        s = signatures.astype(np.uint64)
        weights = np.random.Generator(np.random.Philox(key=[self.symbols, self.chunks])).integers(1, 1 << 63, self.symbols, np.uint64) * np.uint64(2) + np.uint64(1)
        terms, out = (s + np.uint64(1)) * weights, []
        for a, b in self.bounds():
            whole = terms[:, a:b].sum(1, dtype=np.uint64)
            out += [mixed(whole - terms[:, k] + np.uint64((k + 1) * int(MULTIPLIER) & (1 << 64) - 1)) for k in range(a, b)]
        return np.stack(out, 1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64 over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(dict):
    """64-bit hash of each word; emptied when full, which bounds memory and changes nothing else."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


WORDS = Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a whole text; of all its words if there are fewer.

    A-Z in lower case, words between ASCII blanks.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WIDTH + 1)
    out = np.full(n, min(len(h), WIDTH), np.uint64)
    for k in range(min(len(h), WIDTH)):
        out = out * MULTIPLIER + h[k : k + n]
    return np.unique(mixed(out))


def signature(hashes: np.ndarray, symbols: int, slice_rows: int = 4096) -> np.ndarray:
    """Low byte of the minimum of each of ``symbols`` seeded hash functions."""
    g = np.random.Generator(np.random.Philox(key=[symbols, 1]))
    a = g.integers(0, 1 << 63, symbols, np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(symbols, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), slice_rows):
        x = a[:, None] * hashes[None, k : k + slice_rows]
        x ^= x >> np.uint64(32)
        x *= MULTIPLIER
        low = np.minimum(low, x.min(1))
    return (mixed(low) & np.uint64(255)).astype(np.uint8)


def _signed(rows: DataFrame, index: Index) -> DataFrame:
    """(did, n_shingles, h1, h2, sig): 128-bit hash of the whole set, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                n, h1, h2, sigs = [], [], [], []
                for text in part.column(1):
                    s = shingles(text.as_py())
                    d = xxhash.xxh3_128_intdigest(s.tobytes())
                    n.append(len(s))
                    h1.append((d >> 64) - (1 << 63))
                    h2.append((d & (1 << 64) - 1) - (1 << 63))
                    sigs.append(signature(s, index.symbols).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary())], ["did", "n_shingles", "h1", "h2", "sig"])

    kind = rows.schema["did"].dataType.simpleString()
    return rows.mapInArrow(run, f"did {kind}, n_shingles long, h1 long, h2 long, sig binary")


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the rows (a, b, text_a, text_b) whose whole shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b, good = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k, (x, y) in enumerate(zip(a, b, strict=True)):
                if y != last:
                    last, hub = y, shingles(batch.column(3)[k].as_py())
                own = shingles(batch.column(2)[k].as_py())
                both = len(np.intersect1d(own, hub, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(hub) - both):
                    good.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())], ["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def minhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, index: Index | None = None, block_rows: int = 512) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents link when 100 * intersection >= ``percent`` * union of their shingle sets. 1. Rows of equal sets are one class
    (128-bit set hash, map-side combined). 2. Each class is entered in the multi-index; buckets of one class are dropped.
    3. In each bucket every class is held against the most central one, which is likest to the text the others were made from: pairs within the signature radius are confirmed on whole sets, and
    joined to components. Copies of a text so cost one comparison each, however many they are. 4. Buckets that still hold
    several components are compared in full, in blocks over many tasks, and a pair only in its first common bucket. Shingles
    that no other document of these buckets has bound each intersection from above: documents and pairs whose bound is
    below the similarity cannot link and are let go. Pairs of two components within the radius are confirmed on whole
    sets. So no link within the radius that joins components is left out.

    ``percent`` should be 80 or more. The chance that a pair just at the threshold lies outside the radius is ``index.miss(percent / 100)``.
    Null or blank text has no shingles: n_shingles 0, its own component, kept. component_id is the smallest id of a
    component that is not null; a row of null id is kept only where that is null too. Rows that repeat id and text share one verdict. An empty table gives no rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    index = index or Index()
    rows = df.select(F.col(f"`{id_col}`").alias("did"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = stage(_signed(rows, index), "minhash-signatures")
    classes = signed.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("did").alias("first"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()), "minhash-classes")

    def entered(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                keys = index.keys(sigs).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1])), pa.array(keys.ravel())], ["id", "key"])

    entries = classes.select("id", "sig").mapInArrow(entered, "id long, key long")
    shared = stage(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "minhash-shared")
    multi = stage(entries.join(shared, "key"), "minhash-entries")
    unstage(shared)
    # The middle of a bucket: of its classes the one that shares most places with others over all its buckets.
    central = stage(multi.groupBy("id").agg(F.sum("n").alias("score")), "minhash-central")
    hubs = stage(multi.join(central, "id").groupBy("key").agg(F.max(F.struct("score", "id"))["id"].alias("hub")), "minhash-hubs")

    def near(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                n, m = (batch.column(k).to_numpy() for k in (4, 5))
                good = ((x != y).sum(1) <= index.radius) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                yield batch.select([0, 1]).filter(pa.array(good))

    sig = classes.select("id", "sig", "n_shingles")
    stars = multi.join(hubs, "key").filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    stars = stars.join(sig.toDF("a", "sig_a", "n_a"), "a").join(sig.toDF("b", "sig_b", "n_b"), "b").select("a", "b", "sig_a", "sig_b", "n_a", "n_b")
    stars = stage(stars.mapInArrow(near, "a long, b long"), "minhash-stars")

    # Texts of all classes that share a bucket, moved once.
    wanted = classes.join(multi.select("id").distinct(), "id", "left_semi").select("id", "h1", "h2")
    wanted = wanted.join(signed.groupBy("h1", "h2").agg(F.min("did").alias("did")), ["h1", "h2"]).select("did", F.col("id").alias("cid"), F.col("h1").alias("w1"), F.col("h2").alias("w2"))
    texts = _texts(rows, wanted)

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        sides = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        return stage(_similar(sides, percent), name)

    links = confirmed(stars, "minhash-links")
    found = components(links)
    placed = stage(multi.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "minhash-placed")
    unstage(multi, central, hubs)
    split = stage(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key"), "minhash-split")
    left = stage(placed.join(split, "key").select("id").distinct().join(classes.select("id", "n_shingles"), "id"), "minhash-left")
    left = _linkable(left, texts, percent)
    open_rows = placed.join(split, "key").join(left, "id").join(classes.select("id", "sig"), "id").select("key", "n", "id", "component", "n_shingles", "own", "sig")

    def crossing(c, left, right):
        size, comp, sigs = c["n_shingles"], c["component"], c["sig"]
        most = size - c["own"]
        found = []
        for k in range(0, len(left), 64):
            part = left[k : k + 64]
            bound = np.minimum(most[part][:, None], most[right][None, :])
            fit = (comp[part][:, None] != comp[right][None, :]) & (100 * bound >= percent * (size[part][:, None] + size[right][None, :] - bound))
            i, j = np.nonzero(fit)
            i, j = part[i], right[j]
            once = i < j if left is right else np.ones(len(i), bool)
            i, j = i[once], j[once]
            close = (sigs[i] != sigs[j]).sum(1) <= index.radius
            found.append(np.stack((i[close], j[close])))
        i, j = np.concatenate(found, 1)
        if not len(i):
            return None
        rows, at = np.unique(np.concatenate((i, j)), return_inverse=True)
        keys = index.keys(sigs[rows]).view(np.int64)
        i_keys, j_keys = keys[at[: len(i)]], keys[at[len(i) :]]
        first = i_keys[np.arange(len(i)), (i_keys == j_keys).argmax(1)] == c["key"][i]
        return {"a": c["id"][i[first]], "b": c["id"][j[first]]} if first.any() else None

    rest = stage(compared(open_rows, block_rows, crossing, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "minhash-rest")
    more = confirmed(rest, "minhash-more")
    unstage(placed, split)
    final = components(links.union(more))
    named = classes.select("id", "first", "h1", "h2").join(final.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    verdict = stage(named.join(lowest, "component").select("h1", "h2", "component_id"), "minhash-verdict")
    unstage(classes, stars, texts, links, left, rest, more)
    out = signed.select("did", "n_shingles", "h1", "h2").join(verdict, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("did")).otherwise(F.col("component_id"))
    return out.select(F.col("did").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("did") == component, component.isNull()).alias("kept"))


def _linkable(left: DataFrame, texts: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """Those of ``left`` (id, n_shingles) that may have a link among them, with ``own``: shingles no other one has.

    An intersection holds none of a document's own shingles, so it has n_shingles - own at most, and a union n_shingles at least.
    Documents let go in one round leave others with more shingles of their own in the next.
    """

    def exploded(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingles(t.as_py()).view(np.int64) for t in part.column(1)]
                if sets:
                    ids = np.repeat(part.column(0).to_numpy(), [len(s) for s in sets])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets))], ["id", "shingle"])

    whole = held = stage(texts.join(left.select("id"), "id", "left_semi").mapInArrow(exploded, "id long, shingle long"), "minhash-shingles")
    for _ in range(rounds):
        single = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n = 1")
        own = single.groupBy("id").agg(F.count(F.lit(1)).alias("own"))
        left = left.select("id", "n_shingles").join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        left = stage(left.filter(100 * (F.col("n_shingles") - F.col("own")) >= percent * F.col("n_shingles")), "minhash-left")
        held = held.join(left.select("id"), "id", "left_semi")
    unstage(whole)
    return left


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of one row of each wanted class. An id that repeats with other texts is told apart by its set's hash."""

    def chosen(batches):
        import xxhash

        for batch in batches:
            good = []
            for t, w1, w2 in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                d = xxhash.xxh3_128_intdigest(shingles(t.as_py()).tobytes())
                good.append(((d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)) == (w1, w2))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    held = rows.join(wanted.withColumnRenamed("did", "_did"), F.col("did").eqNullSafe(F.col("_did"))).select(F.col("cid").alias("id"), "text", "w1", "w2")
    return stage(held.mapInArrow(chosen, "id long, text string").dropDuplicates(["id"]), "minhash-texts")
