"""Product codes: equal-average search against full search, and the operator against SQL and a plain version."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import check
from emberline.llm.catalog import ORACLES, QUERIES
from emberline.llm.vector_codes import codebooks_digest, nearest, vector_codes


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 40), st.integers(1, 20), st.integers(1, 9), st.sampled_from([1, 3, 4000]))
def test_search_equals_full_search(seed, n, k, d, size):
    rng = np.random.default_rng(seed)
    x, e = rng.integers(-size, size + 1, (n, d)), rng.integers(-size, size + 1, (k, d))
    dist = ((x[:, None] - e[None]) ** 2).sum(2)
    index, best = nearest(x, e)
    assert index.tolist() == dist.argmin(1).tolist() and best.tolist() == dist.min(1).tolist()


NAN, INF = float("nan"), float("inf")


def plain(rows, parts, entries, rounds, scale):
    kept = [(i, label, [int(np.floor(scale * x)) for x in v]) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([v for _, _, v in kept], object).reshape(len(kept), parts, -1)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0], kept[k][2]))[:entries]
    books = [[x[k, p] for k in first] for p in range(parts)]

    def near(v, book):
        return min((((v - c) ** 2).sum(), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [near(v, books[p])[1] for v in x[:, p]]
            books[p] = [sum(x[j, p] for j in range(len(x)) if own[j] == e) // own.count(e) if e in own else c for e, c in enumerate(books[p])]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in x]
    out = [(i, label, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for (i, label, _), f in zip(kept, found)]
    return [(*r, sum(o[3] for o in out if o[1] == r[1])) for r in out], ",".join(str(y) for b in books for c in b for y in c)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label string, d int, code string").repartition(3)


def rows_of(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in np.round(rng.normal(0, 1, 6), 1)], rng.choice(["a", "b", None])) for i in range(n)]


def test_operator_equals_a_plain_version(spark):
    rows = rows_of(60)
    rows += [rows[5], rows[5], (100, None, "a"), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0], "a"), (102, [NAN] * 6, "b"), (103, [INF] + [0.0] * 5, None), (104, [1.0], "a"), (105, [], "a"), (106, [0.0] * 6, "a"), (107, [0.0] * 6, "b")]
    rows = [(i, v, None if label is None else str(label)) for i, v, label in rows]
    usable = [r for r in rows if r[1] is None or len(r[1]) == 6]
    codes, books = vector_codes(table(spark, rows), parts=3, entries=5, rounds=4, scale=64)
    want, digest = plain(usable, 3, 5, 4, 64)
    got = [(r.vec_id, r.label, r.code, r.error, r.label_error) for r in codes.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert ",".join(map(str, books.ravel().tolist())) == digest


def test_few_rows_and_bad_shapes(spark):
    rows = [(1, [0.5] * 6, None), (2, [0.25] * 6, None)]
    codes, books = vector_codes(table(spark, rows), parts=2, entries=4)
    assert books.shape == (2, 2, 3) and sorted((r.code, r.error, r.label_error) for r in codes.collect()) == [("0000", 0, 0), ("0101", 0, 0)]
    codes, books = vector_codes(table(spark, rows).limit(0))
    assert codes.collect() == [] and codebooks_digest(books) == codebooks_digest(np.zeros((0,)))
    (r,) = vector_codes(table(spark, [(1, [], "a")]))[0].collect()
    assert (r.code, r.error) == ("00" * 8, 0)
    with pytest.raises(ValueError, match="cut into"):
        vector_codes(table(spark, rows), parts=4)
    with pytest.raises(Exception, match="must stay below"):
        vector_codes(table(spark, [(1, [1e30] * 6, "a")]), parts=2)
    (r,) = vector_codes(table(spark, [(None, [1.0] * 6, None)]), parts=2)[0].collect()
    assert (r.vec_id, r.label, r.code, r.label_error) == (None, None, "0000", 0)


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_prefix_trie"])
def test_query_equals_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = check.naive(QUERIES[name](spark, sf).toArrow()), check.naive(con.sql(ORACLES[name]).to_arrow_table())
    assert check.types(got) == check.types(want) and check.canonical(got) == check.canonical(want)
