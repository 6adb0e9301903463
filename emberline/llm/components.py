"""Connected components of link tables, and the in-bucket comparison of hashed rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.plans.staging import stage, unstage
from emberline.session import ship_package


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).collect()[0])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: long): the smallest node it reaches.

    Alternating stars: large-star hangs a node's larger neighbours on the smallest one, small-star its smaller ones, until
    nothing changes; the rounds grow with the logarithm of the longest path. Each half is a map-side combined minimum,
    written out, and a join whose hot side (a hub's links) the adaptive join can split. Only a count and a checksum reach the driver.
    """
    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    state = _state(edges)
    while state[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
        large = stage(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        floor = stage(large.groupBy("u").agg(F.min("v").alias("m")), "cc-floor")
        small = large.join(floor, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        new = stage(small.filter("u <> v").distinct(), "cc")
        unstage(edges, low, large, floor)
        edges, before, state = new, state, _state(new)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def compared(entries: DataFrame, block_rows: int, compare: Callable, schema: str) -> DataFrame:
    """Apply ``compare`` to the rows of every bucket, in blocks that bound a task's memory.

    ``entries`` has key (the bucket), n (its rows), id and more. A bucket of more than ``block_rows`` rows is cut by a hash of
    id; every pair of blocks is a group of its own, with each of its rows in it, so a hot bucket becomes many tasks. ``compare``
    gets (columns of the group by name, left rows, right rows) as arrays; left and right are the same for a block with itself. It returns
    columns of ``schema``, so pairs need not be written out.
    """
    ship_package(entries.sparkSession)
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    cut = entries.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cut = cut.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "n")
    rows = cut.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def groups(table: pa.Table, last: bool):
            nonlocal rest
            key, low, high = (table.column(c).to_numpy() for c in ("key", "low", "high"))
            new = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            starts = np.concatenate(([0], new))
            ends = np.concatenate((new, [len(key)]))
            if not last:
                rest = table.slice(int(starts[-1]))
                starts, ends = starts[:-1], ends[:-1]
            columns = {c: _array(table.column(c)) for c in table.column_names}
            found = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s < 2:
                    continue
                own = columns["block"][s:e]
                rows_of = np.arange(s, e)
                left, right = (rows_of, rows_of) if low[s] == high[s] else (rows_of[own == low[s]], rows_of[own == high[s]])
                if len(left) and len(right) and (out := compare(columns, left, right)) is not None:
                    found.append(out)
            if found:
                yield pa.RecordBatch.from_pydict({c: np.concatenate([f[c] for f in found]) for c in found[0]})

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                yield from groups(pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table, False)
        if rest is not None and rest.num_rows:
            yield from groups(rest, True)

    return rows.mapInArrow(run, schema)


def _array(column: pa.ChunkedArray) -> np.ndarray:
    """One-dimensional, or a row per value: lists (shorter ones end in zeros) and binaries of equal size."""
    a = column.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    if pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
        flat, lens = a.flatten().to_numpy(zero_copy_only=False), np.diff(a.offsets.to_numpy())
        if (lens == lens[:1]).all():
            return flat.reshape(len(a), -1)
        out = np.zeros((len(a), lens.max()), flat.dtype)
        out[np.arange(lens.max()) < lens[:, None]] = flat
        return out
    if pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type):
        return np.frombuffer(b"".join(a.to_pylist()), np.uint8).reshape(len(a), -1)
    return a.to_numpy(zero_copy_only=False)


def group_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` points reaches over the links (i, j), by pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
