"""Token files: one wavelet matrix per segment, one compressed file per shard."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.tokens import encoded_rows
from emberline.session import ship_package

BLOCK = 64  # bytes between two stored ranks


class WaveletMatrix:
    """Bit planes of a sequence, highest bit first; after each plane zeros move stably before ones."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for k in range(bits - 1, -1, -1):
            b = (a >> k & 1).astype(bool)
            plane = np.packbits(b)
            ones = np.flatnonzero(b)
            a = np.concatenate((a.take(np.flatnonzero(~b)), a.take(ones)))
            zeros.append(len(a) - len(ones))
            planes.append(plane)
            counts = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK), dtype=np.uint32) if len(plane) else np.zeros(0, np.uint32)
            ranks.append(np.concatenate((np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32))))
        return cls(len(a), zeros, planes, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones before place ``i`` of a plane: a stored rank and the bits of less than one block."""
        byte, block = i >> 3, (i >> 3) // BLOCK
        plane = self.planes[level]
        n = int(self.ranks[level][block]) + int(np.bitwise_count(plane[block * BLOCK : byte]).sum())
        return n + (int(plane[byte]) >> (8 - (i & 7))).bit_count() if i & 7 else n

    def access(self, i: int) -> int:
        v = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i >> 3]) >> (7 - (i & 7)) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            v = v << 1 | bit
        return v

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        start, end = 0, i
        for level, z in enumerate(self.zeros):
            a, b = self._ones(level, start), self._ones(level, end)
            start, end = (z + a, z + b) if symbol >> (len(self.zeros) - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def rank(self, symbol: int, i: int | None = None) -> int:
        """Occurrences of ``symbol`` before place ``i``; in all without it."""
        start, end = self._range(symbol, self.n if i is None else i)
        return end - start

    def _find(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value, by binary search over ranks."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            low, high = (mid + 1, high) if (ones if bit else mid + 1 - ones) <= k else (low, mid)
        return low

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``symbol``."""
        start, end = self._range(symbol, self.n)
        if k >= end - start:
            raise IndexError(f"{symbol} occurs {end - start} times")
        at = start + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = symbol >> (len(self.planes) - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.rank(symbol))]

    def decode(self) -> np.ndarray:
        """The whole sequence, planes undone from the lowest."""
        v = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            b = np.unpackbits(self.planes[level], count=self.n).view(bool)
            z, w = self.zeros[level], np.empty_like(v)
            w[np.flatnonzero(~b)] = v[:z]
            w[np.flatnonzero(b)] = v[z:] | v.dtype.type(1 << (len(self.planes) - 1 - level))
            v = w
        return v

    @classmethod
    def from_row(cls, row: dict) -> WaveletMatrix:
        planes = [np.frombuffer(p, np.uint8) for p in row["planes"]]
        return cls(row["n_tokens"], row["zeros"], planes, [np.frombuffer(r, np.uint32) for r in row["ranks"]])


COLUMNS = ["shard", "segment", "doc_ids", "doc_tokens", "n_tokens", "zeros", "planes", "ranks"]


def write_token_shards(
    df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, bits: int = 16, segment_tokens: int = 1 << 20
) -> None:
    """Write ``df`` as token shards in ascending id order, null ids first.

    Rows are range-partitioned by id and a hash of the text, so that texts of one id or of none are spread (the text is shuffled once), sorted within, and each partition is one shard: one
    zstd parquet file with a row per segment of whole documents, about ``segment_tokens`` ids each, so a task holds one
    segment at a time. A segment has the wavelet matrix (bit planes, zeros, a rank for every 512 bits) and its documents'
    ids and lengths. Null or empty text has the end id alone; rows that repeat an id follow one another. Ids must fit ``bits`` bits.
    """
    ship_package(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def segments(batches):
        shard, segment, types = TaskContext.get().partitionId(), 0, []

        def typed():
            for batch in batches:
                types[:] = [pa.int32(), pa.int32(), pa.list_(batch.schema.field(0).type), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]
                yield batch

        def flush(ids, raws):
            tokens = np.frombuffer(b"".join(raws), "<u4")
            if int(tokens.max()) >> bits:
                raise ValueError(f"token id {int(tokens.max())} needs more than {bits} bits")
            m = WaveletMatrix.build(tokens, bits)
            row = (shard, segment, ids, [len(r) // 4 for r in raws], m.n, m.zeros, [p.tobytes() for p in m.planes], [r.tobytes() for r in m.ranks])
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], COLUMNS)

        ids, raws, size = [], [], 0
        for i, raw in encoded_rows(typed(), tokenizer, end_id):
            ids.append(i)
            raws.append(raw)
            size += len(raw) // 4
            if size >= segment_tokens:
                yield flush(ids, raws)
                ids, raws, size, segment = [], [], 0, segment + 1
        if ids:
            yield flush(ids, raws)

    schema = f"shard int, segment int, doc_ids array<{kind}>, doc_tokens array<long>, n_tokens long, zeros array<long>, planes array<binary>, ranks array<binary>"
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text").mapInArrow(segments, schema).write.option("compression", "zstd").parquet(path)


def segment_starts(files: DataFrame) -> DataFrame:
    """(shard, segment, before): ids in all segments before each. Two sums, over shards and within one, of segment lengths alone."""
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    ahead = shards.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("ahead"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    return files.select("shard", "segment", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("own")).join(ahead, "shard").select("shard", "segment", (F.col("own") + F.col("ahead")).alias("before"))


def read_documents(spark: SparkSession, path: str, checksums: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document decoded from the files; ``start`` counts the ids of all documents before it.

    With ``checksums`` the column ids_crc32 stands in place of the ids: they are decoded in full, but do not leave their task.
    """
    ship_package(spark)
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    content, content_type = ("ids_crc32", "long") if checksums else ("ids", "binary")

    def decoded(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).select([c for c in COLUMNS if c != "doc_ids"]).to_pylist()[0]
                ids = WaveletMatrix.from_row(row).decode().astype("<u4")
                n = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(n)
                cuts = np.concatenate(([0], 4 * ends)).astype(np.int32)
                if checksums:
                    whole = memoryview(ids).cast("B")
                    raw = pa.array([zlib.crc32(whole[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.int64())
                else:
                    raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(n), pa.int32()), pa.array([row["segment"]] * len(n), pa.int32()), batch.slice(k, 1).column(2).flatten(), pa.array(ends - n), pa.array(n), raw],
                    ["shard", "segment", "doc_id", "local", "n_tokens", content],
                )

    docs = files.select(*COLUMNS).mapInArrow(decoded, f"shard int, segment int, doc_id {kind}, local long, n_tokens long, {content} {content_type}")
    return docs.join(segment_starts(files), ["shard", "segment"]).select("doc_id", (F.col("local") + F.col("before")).alias("start"), "n_tokens", content)


def token_counts(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(shard, n): occurrences of a token, from ranks alone."""
    ship_package(spark)

    def counted(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([r["shard"] for r in rows], pa.int32()), "n": pa.array([WaveletMatrix.from_row(r).rank(token) for r in rows], pa.int64())})

    return spark.read.parquet(path).select("shard", "n_tokens", "zeros", "planes", "ranks").mapInArrow(counted, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n"))


def token_places(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(place): every place of a token in the whole corpus, by select."""
    ship_package(spark)
    files = spark.read.parquet(path)

    def placed(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                at = WaveletMatrix.from_row(row).occurrences(token)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([row["shard"]] * len(at), pa.int32()), "segment": pa.array([row["segment"]] * len(at), pa.int32()), "local": pa.array(at, pa.int64())})

    found = files.select("shard", "segment", "n_tokens", "zeros", "planes", "ranks").mapInArrow(placed, "shard int, segment int, local long")
    return found.join(segment_starts(files), ["shard", "segment"]).select((F.col("local") + F.col("before")).alias("place"))
