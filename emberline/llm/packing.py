"""Packing of documents into sequences of equal attention cost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.tokens import encoded_rows
from emberline.session import ship_package


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int]], list[float]]:
    """(document, start, length, sequence) of each piece, and each sequence's cost.

    Documents longer than a sequence give full sequences first. What is left is taken in descending length; each goes
    to the sequence of lowest cost that still has room for it. When none has, it is cut to fill the cheapest one that
    has any. So only the last sequence's worth of room, less than one sequence, can stay empty.
    """
    cost_of = lambda n: linear * n + quadratic * n * n
    out, costs, rest = [], [], []
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            out.append((d, start, capacity, len(costs)))
            costs.append(cost_of(capacity))
        if n % capacity:
            rest.append((n % capacity, d, n - n % capacity))
    full, total = len(costs), sum(n for n, _, _ in rest)
    room = np.full(-(-total // capacity), capacity, np.int64)
    cost = np.zeros(len(room))
    rest.sort(key=lambda r: (-r[0], r[1]))
    for n, d, start in rest:
        while n:
            fits = np.where(room >= n, cost, np.inf)
            s = int(fits.argmin())
            if fits[s] == np.inf:
                s = int(np.where(room > 0, cost, np.inf).argmin())
            take = min(n, int(room[s]))
            out.append((d, start, take, full + s))
            room[s] -= take
            cost[s] += cost_of(take)
            n, start = n - take, start + take
    return out, costs + cost.tolist()


def pack(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    block_tokens: int = 1 << 19,
) -> DataFrame:
    """One row per piece: id, start, length, ids (packed unsigned 32-bit), doc_tokens, sequence_id, offset, costs.

    A map over the input's own partitions, without a shuffle: each task packs blocks of about ``block_tokens`` tokens,
    so its memory does not depend on the partition, and less than one sequence per block stays empty. The cost of a
    piece is ``linear * n + quadratic * n * n``; attention stays inside a piece. ``sequence_id`` is unique across tasks
    (the partition in the high bits) and the same when a task is run again on the same partition.

    Null or empty text has its end id alone. Ids may be null or repeat; each row is packed. Other columns are not read.
    """
    ship_package(df.sparkSession)

    def packed(batches):
        base, at = TaskContext.get().partitionId() << 33, 0

        def flush(ids, raws):
            nonlocal at
            lengths = [len(r) // 4 for r in raws]
            pieces, costs = assign(lengths, capacity, linear, quadratic)
            used: dict[int, int] = {}
            cols: list[list] = [[] for _ in range(9)]
            for d, start, n, s in pieces:
                offset = used.get(s, 0)
                used[s] = offset + n
                for c, v in zip(cols, (ids[d], start, n, raws[d][4 * start : 4 * (start + n)], lengths[d], base + at + s, offset, linear * n + quadratic * n * n, costs[s]), strict=True):
                    c.append(v)
            at += len(costs)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow, strict=True)], names)

        ids, raws, size = [], [], 0
        def typed():
            for batch in batches:
                arrow[0] = batch.schema.field(0).type
                yield batch

        for i, raw in encoded_rows(typed(), tokenizer, end_id):
            ids.append(i)
            raws.append(raw)
            size += len(raw) // 4
            if size >= block_tokens:
                yield from flush(ids, raws)
                ids, raws, size = [], [], 0
        if ids:
            yield from flush(ids, raws)

    kind = df.schema[id_col].dataType.simpleString()
    arrow = [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "piece_cost", "sequence_cost"]
    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, piece_cost double, sequence_cost double"
    out = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(packed, schema)
    return out.withColumnRenamed("id", id_col)
