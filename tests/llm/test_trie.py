"""Prefix tries of rebuilt conversations against a plain version."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm.prefix_trie import SpillingQueue, prefix_trie


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    turns = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        way = turns.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:]
        for d in range(len(way) + 1):
            members[tuple(way[:d])].append(c)
        ends[tuple(way)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, m in members.items()
    )


def trie(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string").repartition(3)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in prefix_trie(df, **kw).collect())


def conversations(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(-3, n):
        for t in range(int(rng.integers(0, 12))):
            rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", "assistant", None]), rng.choice(["é", "hello", "", None], p=[0.1, 0.6, 0.1, 0.2])))
    rows = [(c, t, None if r is None else str(r), None if x is None else str(x)) for c, t, r, x in rows]
    same = [(c, t, "user", "copy" * t) for c in range(1000, 1090) for t in range(3)]
    return rows + rows[:7] + same + [(None, 1, "user", "lost")] + [(5000, t, "user", "long" * (t % 3)) for t in range(700)] + [(5003, 0, "u", "x" * 100_000)]


@pytest.mark.parametrize("kw", [{}, {"shard_members": 1}, {"shard_members": 5, "queue_limit": 2}, {"shard_members": 100_000, "queue_limit": 3}])
def test_trie_equals_a_plain_one(spark, kw):
    rows = conversations(2, 60)
    assert trie(spark, rows, **kw) == plain(rows)


def test_small_tables(spark):
    assert trie(spark, [(1, 0, "a", "b")]) == plain([(1, 0, "a", "b")])
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(df).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], df.schema)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3), st.integers(-5, 5)), max_size=40), st.integers(1, 5))
def test_queue_adds_up_messages(messages, limit):
    queue, want = SpillingQueue(limit), defaultdict(int)
    for d, k, v in messages:
        queue.push(d, bytes([k] * 16), (1, v, 2 * v))
        want[d, k] += v
    for d in range(4, -1, -1):
        for k in range(4):
            n, a, b = queue.pop(d, bytes([k] * 16))
            assert (a, b) == (want[d, k], 2 * want[d, k])
    assert len(queue) == 0
