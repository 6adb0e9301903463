"""The trie of conversation prefixes, its subtree totals by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import struct
import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import digest128
from emberline.plans.staging import stage
from emberline.session import ship_package

ROOT = bytes(16)
RECORD = struct.Struct("<q16s3q")


class SpillingQueue:
    """Messages to nodes that come later in reverse level order (depth falling, then key rising), added up by node.

    At most ``limit`` messages stay in memory. Beyond that they are sorted, messages to one node added up, and written as a run to an unnamed
    file in the folder where Spark itself spills; runs are read in order, a little at a time. Only the writing task
    reads its runs, and a task that starts again writes its own.
    """

    def __init__(self, limit: int = 200_000):
        self.limit, self.heap, self.runs, self.heads = limit, [], [], []
        self.folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None

    def push(self, depth: int, node: bytes, values: tuple[int, int, int]) -> None:
        heapq.heappush(self.heap, (-depth, node, *values))
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        run = tempfile.TemporaryFile(dir=self.folder)
        messages, self.heap = sorted(self.heap), []
        at = 0
        while at < len(messages):
            depth, node, *total = messages[at]
            at += 1
            while at < len(messages) and messages[at][:2] == (depth, node):
                total = [a + b for a, b in zip(total, messages[at][2:], strict=True)]
                at += 1
            run.write(RECORD.pack(depth, node, *total))
        run.seek(0)
        self.runs.append(run)
        self._head(len(self.runs) - 1)

    def _head(self, k: int) -> None:
        raw = self.runs[k].read(RECORD.size)
        if raw:
            heapq.heappush(self.heads, (*RECORD.unpack(raw), k))
        else:
            self.runs[k].close()

    def pop(self, depth: int, node: bytes) -> tuple[int, int, int]:
        """Sum of the messages to a node; nodes are asked for in reverse level order."""
        key, total = (-depth, node), (0, 0, 0)
        while self.heap and self.heap[0][:2] == key:
            total = tuple(a + b for a, b in zip(total, heapq.heappop(self.heap)[2:], strict=True))
        while self.heads and self.heads[0][:2] == key:
            head = heapq.heappop(self.heads)
            total = tuple(a + b for a, b in zip(total, head[2:5], strict=True))
            self._head(head[5])
        return total

    def __len__(self) -> int:
        return len(self.heap) + len(self.heads)


def _rebuilt(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, group: int, most: int) -> DataFrame:
    """(conv, part, pos, turn, role, digest, bytes): turns borrowed from the first conversation of a group of ids, then own turns."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    own = df.filter(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"),
        F.col(f"`{turn_col}`").alias("turn"),
        role.alias("role"),
        digest128(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    heads = own.filter(F.col("conv") % group == 0).withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most)
    convs = own.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % group).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).alias("h"))
    heads = heads.select(F.col("conv").alias("base"), "pos", "digest", "bytes")
    borrowed = convs.join(heads, "base").filter("pos <= h").select("conv", F.lit(0).alias("part"), "pos", F.lit(None).cast(own.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), "digest", "bytes")
    return own.select("conv", F.lit(1).alias("part"), F.lit(0).alias("pos"), "turn", "role", "digest", "bytes").unionByName(borrowed)


def _paths(rebuilt: DataFrame, most: int) -> DataFrame:
    """(conv, depth, node, parent, bytes, ends): the nodes on each conversation's way from the root.

    Turns are sorted by conversation and streamed; the state is one digest, so a very long conversation needs no memory.
    A node is named by the 128-bit digest of its parent's name and its last turn.
    """

    def walked(batches):
        conv, held, own, skip = None, None, 0, 0
        for batch in batches:
            out = []
            for c, part, digest, size in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if c != conv:
                    if held:
                        out.append((*held, True))
                    conv, own, skip = c, 0, zlib.crc32(str(c).encode()) % (most + 1)
                    held = (c, 0, ROOT, None, 0)
                if part:
                    own += 1
                    if own <= skip:
                        continue
                out.append((*held, False))
                held = (c, held[1] + 1, hashlib.blake2b(held[2] + digest, digest_size=16).digest(), held[2], size)
            if out:
                yield _batch(out)
        if held:
            yield _batch([(*held, True)])

    def _batch(rows):
        kinds = pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv", "depth", "node", "parent", "bytes", "ends"])

    order = "conv", "part", "pos", F.asc_nulls_first("turn"), "role", "digest"
    ordered = rebuilt.repartition("conv").sortWithinPartitions(*order).select("conv", "part", "digest", "bytes")
    return ordered.mapInArrow(walked, "conv long, depth long, node binary, parent binary, bytes long, ends boolean")


NODE = "conv_id long, depth long, node binary, parent binary, n_convs long"
TOTALS = f"{NODE}, n_children long, n_leaves long, saved_tokens long, top boolean"


def _passed_up(nodes: DataFrame, limit: int) -> DataFrame:
    """Subtree totals of nodes (with ``shard``, ``bytes`` and what children elsewhere sent: ``n_children``, ``n_leaves``, ``saved_tokens``).

    Spark sorts the nodes of a task by falling depth and rising name, on disk if need be. Each takes the messages of its children from
    the queue, adds its own share, and sends the sum forward to its parent, unless it is the root of its shard.
    """

    def passed(batches: Iterator[pa.RecordBatch]):
        queue = SpillingQueue(limit)
        for batch in batches:
            out = []
            for conv, depth, node, parent, n_convs, size, shard, *sent in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                children, leaves, saved = (a + b for a, b in zip(queue.pop(depth, node), sent, strict=True))
                leaves, saved = leaves + (not children), saved + (n_convs - 1) * size
                if node != shard:
                    queue.push(depth - 1, parent, (1, leaves, saved))
                out.append((conv, depth, node, parent, n_convs, children, leaves, saved, node == shard))
            kinds = [f.dataType for f in schema]
            arrow = {T.LongType(): pa.int64(), T.BinaryType(): pa.binary(), T.BooleanType(): pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(v, arrow[t]) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], schema.names)
        if len(queue):
            raise ValueError(f"{len(queue)} messages to nodes that are not in this shard")

    schema = T._parse_datatype_string(TOTALS)
    ordered = nodes.sortWithinPartitions(F.desc("depth"), "node")
    return ordered.select("conv_id", "depth", "node", "parent", "n_convs", "bytes", "shard", "n_children", "n_leaves", "saved_tokens").mapInArrow(passed, schema)


def _ends(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256): digest of the ids that end in a node, numerically ascending.

    Ids are sorted over all tasks and joined to strings of some ten thousand, so a node where a third of all conversations
    end is spread; its strings then stream through one hash in order.
    """

    def joined(batches):
        node, ids = None, []

        def run():
            return pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "first": pa.array([ids[0]], pa.int64()), "ids": pa.array([",".join(map(str, ids))])})

        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (n != node or len(ids) == 10_000):
                    yield run()
                    ids = []
                node = n
                ids.append(c)
        if ids:
            yield run()

    def hashed(batches):
        node, state = None, None

        def done():
            return pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": pa.array([state.hexdigest()])})

        for batch in batches:
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n == node:
                    state.update(b"," + text.encode())
                    continue
                if state:
                    yield done()
                node, state = n, hashlib.sha256(text.encode())
        if state:
            yield done()

    ends = paths.filter("ends").select("node", "conv")
    runs = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(joined, "node binary, first long, ids string")
    return runs.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(hashed, "node binary, ends_sha256 string")


def prefix_trie(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 5, most: int = 8, shard_members: int | None = None, queue_limit: int = 200_000
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c is rebuilt from the first h turns of conversation c - c % group (all if fewer, none if it is absent) and its own
    turns after its first h, with h = crc32(c) % (most + 1). Turns are ordered by turn (null first), then role, then the digest of
    role and text. Only digests and lengths of texts are shuffled.

    Nodes with at most ``shard_members`` member conversations whose parent has more are roots of shards (by default the
    square root of the rows of all paths, 64 at least). Shards are dealt to tasks whole and worked bottom up (``_passed_up``). The nodes above them, fewer than rows / shard_members
    since each takes more than that many rows, then take the sums of the shard roots in the same way. That bound also holds where they are broadcast.

    Null role or text is empty. Rows without conversation id belong to no conversation. Repeated rows are turns of their own. A conversation
    rebuilt without turns ends in the root. Other columns are ignored. An empty table gives no rows. Ids must be integers.
    """
    ship_package(df.sparkSession)
    paths = stage(_paths(_rebuilt(df, conv_col, turn_col, role_col, text_col, group, most), most), "trie-paths")
    nodes = paths.groupBy("node").agg(F.min("conv").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_convs"))
    nodes = stage(nodes, "trie-nodes")
    rows = nodes.agg(F.sum("n_convs")).collect()[0][0] or 0
    limit = shard_members or max(64, math.isqrt(rows))
    heavy, light = nodes.filter(F.col("n_convs") > limit), nodes.filter(F.col("n_convs") <= limit)
    above = F.broadcast(heavy.select("node", F.lit(True).alias("heavy")))

    below = paths.select("conv", "depth", "node").join(above, "node", "left_anti")
    shards = below.groupBy("conv").agg(F.min_by("node", "depth").alias("shard"))
    nothing = [F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    dealt = light.join(shards, F.col("conv_id") == F.col("conv")).select("*", *nothing).repartition("shard")
    low = stage(_passed_up(dealt, queue_limit), "trie-shards")
    sent = low.filter("top AND parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    upper = heavy.join(sent.withColumnRenamed("parent", "of"), F.col("node") == F.col("of"), "left").na.fill(0, ["n_children", "n_leaves", "saved_tokens"])
    high = _passed_up(upper.withColumn("shard", F.lit(ROOT)).repartition(1), queue_limit)

    # A parent is above the shards, or in the shard of its child.
    child = ["conv_id", "depth", "node", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    parents = nodes.select(F.col("node").alias("of"), F.col("conv_id").alias("parent_conv_id"))
    inside = low.filter("NOT top").select(child).join(light.select(F.col("node").alias("of"), F.col("conv_id").alias("parent_conv_id")), F.col("parent") == F.col("of"))
    over = high.select(child).unionByName(low.filter("top").select(child)).join(F.broadcast(parents.join(above.withColumnRenamed("node", "of"), "of", "left_semi")), F.col("parent") == F.col("of"), "left")
    ends = _ends(paths).withColumnRenamed("node", "_of")
    out = inside.unionByName(over).join(ends, F.col("node") == F.col("_of"), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
