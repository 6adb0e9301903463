"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.components import compared, components, group_roots
from emberline.plans.staging import stage
from emberline.session import ship_package


def collision(distance: float, width: float) -> float:
    """Probability that two points at that distance share one quantised Gaussian projection."""
    x = width / distance
    return 1 - 2 * NormalDist().cdf(-x) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def hash_plan(rows: int, cosine: float, width: float, miss: float) -> tuple[int, int]:
    """(projections per table, tables): unrelated unit vectors (at right angles) meet by chance in a tenth of a bucket at
    most, and a pair at the threshold is missed by every table with probability ``miss`` at most."""
    near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(10 * max(rows, 10)) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log(1 - near**k))


def embedding_dedup(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, width: float = 1.6, miss: float = 1e-6, seed: int = 19, block_rows: int = 512
) -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id, kept.

    1. Equal vectors of a label become one class with a count (map-side combined), so copies cost nothing further.
    2. Each class gets a bucket in every table: its unit vector's Gaussian projections, shifted, divided by ``width`` and
    floored. Table and projection counts follow from the rows, the threshold and ``miss``, see ``hash_plan``.
    3. Buckets of one class are dropped before vectors are moved. The rest are compared in blocks; exact cosines in
    double precision decide. A pair that meets in several tables counts in the first. A task returns sums and
    the group's components, not pairs. 4. Alternating stars join the components.

    Only rows of equal, non-null labels are compared. A vector that is null, empty, zero or holds null or non-finite components
    links with nothing: n_links 0, its own component, kept. Vectors of unequal length do not link. component_id is the smallest id of a component
    that is not null; a row of null id is kept only where that is null too. Rows that repeat an id and vector link with each other. An empty table gives no rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    raw = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.coalesce(F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(raw, lambda x: x != 0) & F.col(f"`{label_col}`").isNotNull(), F.lit(False))
    rows = df.select(F.col(f"`{id_col}`").alias("vid"), F.col(f"`{label_col}`").alias("label"), F.when(fine, raw).alias("v"))
    classes = rows.filter("v is not null").groupBy("label", "v").agg(F.min("vid").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    most = classes.groupBy("label").count().agg(F.max("count")).collect()[0][0] or 0
    k, tables = hash_plan(most, cosine, width, miss)

    def hashed(batches):
        for batch in batches:
            vectors = batch.column(2)
            lens = np.diff(vectors.offsets.to_numpy())
            flat, keys = vectors.flatten().to_numpy(zero_copy_only=False), np.zeros((batch.num_rows, tables), np.int64)
            starts = np.cumsum(lens) - lens
            labels = np.array([hash_text(f"{x}") for x in batch.column(1).to_pylist()], np.int64)
            for d in np.unique(lens).tolist():
                at = np.flatnonzero(lens == d)
                x = flat[starts[at][:, None] + np.arange(d)]
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                g = np.random.Generator(np.random.Philox(key=[seed, d]))
                a, shift = g.standard_normal((d, tables * k)), g.random(tables * k) * width
                fold = g.integers(1, 1 << 62, (tables, k), np.int64) * 2 + 1
                cell = np.floor((x @ a + shift) / width).astype(np.int64).reshape(len(at), tables, k)
                with np.errstate(over="ignore"):
                    h = (cell * fold).sum(2) + (np.arange(tables) + 1) * np.int64(0x2545F4914F6CDD1D) + labels[at][:, None]
                    h ^= h >> 29
                    keys[at] = h * np.int64(0x369DEA0F31A53F85) + d
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(keys), pa.list_(pa.int64()))], ["id", "keys"])

    buckets = stage(classes.select("id", "label", "v").mapInArrow(hashed, "id long, keys array<long>"), "vector-buckets")
    entries = buckets.select("id", F.explode("keys").alias("key"))
    shared = stage(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "vector-shared")
    found = stage(entries.join(shared, "key"), "vector-entries")
    payload = classes.select("id", "v", "copies", "label").join(buckets, "id").join(found.select("id").distinct(), "id", "left_semi")
    full = found.join(payload.withColumn("label", F.xxhash64("label", F.size("v"))), "id").select("key", "n", "id", "copies", "label", "keys", "v")

    def cosines(c, left, right):
        v, ids, copies, keys = c["v"], c["id"], c["copies"], c["keys"]
        a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) for x in (v[left], v[right]))
        cos = (a @ b.T) / np.sqrt((a * a).sum(1))[:, None] / np.sqrt((b * b).sum(1))[None, :]
        i, j = np.nonzero((cos >= cosine) & (c["label"][left][:, None] == c["label"][right][None, :]))
        i, j = left[i], right[j]
        once = i < j if left is right else np.ones(len(i), bool)
        i, j = i[once], j[once]
        if not len(i):
            return None
        first = keys[i, (keys[i] == keys[j]).argmax(1)] == c["key"][i]
        base, n = min(left[0], right[0]), max(left[-1], right[-1]) - min(left[0], right[0]) + 1
        links = np.zeros(n, np.int64)
        np.add.at(links, i[first] - base, copies[j[first]])
        np.add.at(links, j[first] - base, copies[i[first]])
        root = group_roots(n, i - base, j - base)
        at = np.unique(np.concatenate((i, j))) - base
        return {"id": ids[at + base], "links": links[at], "root": ids[root[at] + base]}

    linked = stage(compared(full, block_rows, cosines, "id long, links long, root long"), "vector-links")
    groups = components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = classes.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    totals = linked.groupBy("id").agg(F.sum("links").alias("links"))
    verdict = named.join(lowest, "component").join(totals, "id", "left")
    verdict = stage(verdict.select(F.col("label").alias("_label"), F.col("v").alias("_v"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "vector-verdict")
    out = rows.join(verdict, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")), "left")
    component = F.when(F.col("v").isNull(), F.col("vid")).otherwise(F.col("component_id"))
    return out.select(F.col("vid").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vid") == component, component.isNull()).alias("kept"))


def hash_text(s: str) -> int:
    """Signed 64-bit hash that every worker agrees on."""
    import xxhash

    return xxhash.xxh64_intdigest(s) - (1 << 63)
