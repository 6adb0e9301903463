"""Product codes of vectors: integer codebooks, and nearest entries by equal-average search."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.plans.staging import stage
from emberline.session import ship_package


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry; of equally near entries the one of the lowest index.

    Entries are sorted by their component sum. From a row's own sum the search goes outward on both sides; a side is
    done once its squared gap of sums, divided by the number of components, strictly exceeds the best distance, since
    no entry's distance is below that quotient. An equal quotient goes on: that entry may tie with a lower index.
    """
    n, d = x.shape
    sums = entries.sum(1)
    order = np.argsort(sums, kind="stable")
    ranked, own = sums[order], x.sum(1)
    best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, len(entries))
    right = np.searchsorted(ranked, own)
    for at, step in ((right, 1), (right - 1, -1)):
        rows, at = np.arange(n), at.copy()
        while True:
            inside = (at >= 0) & (at < len(entries))
            rows, at = rows[inside], at[inside]
            gap = own[rows] - ranked[at]
            near = -(-gap * gap // max(d, 1)) <= best[rows]
            rows, at = rows[near], at[near]
            if not len(rows):
                break
            e = order[at]
            diff = x[rows] - entries[e]
            dist = (diff * diff).sum(1)
            won = (dist < best[rows]) | ((dist == best[rows]) & (e < index[rows]))
            best[rows[won]], index[rows[won]] = dist[won], e[won]
            at = at + step
    return index, best


def _integers(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, d, v): usable vectors as packed 64-bit integers floor(scale * x)."""
    kinds = [df.schema[id_col].dataType, df.schema[label_col].dataType]

    def packed(batches):
        for batch in batches:
            vectors = batch.column(2)
            lens = np.where(vectors.is_null().to_numpy(zero_copy_only=False), 0, vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            ends = np.cumsum(lens)
            fine = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - lens])
            x = np.floor(scale * flat[np.repeat(fine, lens)])
            widths = lens[fine]
            if len(x) and np.abs(x).max() * widths.max() >= 1 << 30:
                raise ValueError(f"a component times {scale} times the vector's length must stay below 2 ** 30, so that squared sums fit 64 bits")
            cuts = np.concatenate(([0], 8 * np.cumsum(widths))).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(widths), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(x.astype("<i8").tobytes())])
            mask = pa.array(fine)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(widths, pa.int64()), raw], ["id", "label", "d", "v"])

    schema = T.StructType([T.StructField("id", kinds[0]), T.StructField("label", kinds[1]), T.StructField("d", T.LongType()), T.StructField("v", T.BinaryType())])
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).mapInArrow(packed, schema)


def _parts(batch: pa.RecordBatch, k: int, parts: int, d: int) -> np.ndarray:
    """Rows by parts by components of a binary column."""
    column = batch.column(k)
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<i8").reshape(batch.num_rows, parts, d // parts)


def fit_codebooks(ints: DataFrame, d: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, component): first vectors by id, then rounds of assignment and floored means over all rows.

    Each task adds up its own parts by entry; parts x entries x components sums of all rows reach the driver, whatever
    the number of rows. Rows that repeat an id are ordered by their components.
    """
    first = ints.filter(F.col("id").isNotNull()).select("id", "v").orderBy("id", "v").limit(entries).collect()
    if not first:
        first = ints.select("v").orderBy("v").limit(entries).collect()
    books = np.stack([np.frombuffer(r["v"], "<i8").reshape(parts, -1) for r in first], 1)
    width = d // parts
    for _ in range(rounds):

        def summed(batches, books=books):
            totals, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                x = _parts(batch, 0, parts, d)
                for p in range(parts):
                    index, _ = nearest(x[:, p], books[p])
                    np.add.at(totals[p], index, x[:, p])
                    counts[p] += np.bincount(index, minlength=books.shape[1])
            p, e = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(p, width + 1), pa.int32()), pa.array(np.repeat(e, width + 1), pa.int32()), pa.array(np.tile(np.arange(width + 1), len(p)), pa.int32()), pa.array(np.concatenate((totals[p, e], counts[p, e][:, None]), 1).ravel())],
                ["p", "e", "k", "s"],
            )

        sums = ints.select("v").mapInArrow(summed, "p int, e int, k int, s long").groupBy("p", "e", "k").agg(F.sum("s").alias("s")).toArrow()
        p, e, k, s = (sums.column(c).to_numpy() for c in ("p", "e", "k", "s"))
        table = np.zeros((*books.shape[:2], width + 1), np.int64)
        table[p, e, k] = s
        used = table[:, :, width] > 0
        books = books.copy()
        books[used] = table[used][:, :width] // table[used][:, width:]
    return books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of the decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, np.ndarray]:
    """(codes, codebooks): per usable row id, label, code (two hex digits a part), error and label_error.

    Components become integers floor(scale * x); vectors are cut into ``parts`` equal parts, each coded by the nearest
    entry of its position's codebook (``nearest``, ``fit_codebooks``). error sums the squared distances over parts,
    label_error sums errors over equal labels, nulls together: partial sums first, so a label that a third of the rows have is no hot task,
    and rows are joined with one row per label.

    Null vectors and those with null or non-finite components are left out. If lengths differ, the commonest length is
    coded (the larger of equally common ones) and the rest left out; it must be a multiple of ``parts``. Vectors without
    components have entry 0 and error 0. A null id is coded, and starts a codebook only if all ids are null. Repeated
    rows count as often as they occur. With fewer rows than entries the codebooks are shorter. An empty table gives no rows and empty codebooks. Other columns are ignored.
    """
    spark = df.sparkSession
    ship_package(spark)
    ints = stage(_integers(df, id_col, vector_col, label_col, scale), "vector-integers")
    common = ints.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    schema = T.StructType([T.StructField("id", ints.schema["id"].dataType), T.StructField("label", ints.schema["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not common:
        empty = spark.createDataFrame([], schema).withColumn("label_error", F.lit(0).cast("long"))
        return empty.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), np.zeros((parts, 0, 0), np.int64)
    d = common[0]["d"]
    if d % parts:
        raise ValueError(f"{d} components cannot be cut into {parts} equal parts")
    ints = ints.filter(F.col("d") == d)
    books = fit_codebooks(ints, d, parts, entries, rounds)

    def coded(batches):
        for batch in batches:
            x = _parts(batch, 2, parts, d)
            codes, error = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            for p in range(parts):
                codes[:, p], dist = nearest(x[:, p], books[p])
                error += dist
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["id", "label", "code", "error"])

    codes = stage(ints.select("id", "label", "v").mapInArrow(coded, schema), "vector-codes")
    totals = codes.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error"))
    out = codes.join(totals, F.col("label").eqNullSafe(F.col("_of")))
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), books
