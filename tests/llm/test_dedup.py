"""Exact, line, vector and shingle deduplication against brute force, with odd rows."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm.components import components, group_roots
from emberline.llm.embedding_dedup import collision, embedding_dedup, hash_plan
from emberline.llm.exact_dedup import exact_dedup
from emberline.llm.line_dedup import line_dedup
from emberline.llm.minhash_dedup import Index, minhash_dedup, shingles, signature

DOCS = "doc_id long, text string, kept string, n_lines string"  # the last two clash with results


def fold(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hashed", [None, lambda c: F.lit(b"one").cast("binary")])
def test_exact_groups_and_collisions(spark, keep, hashed):
    texts = ["Aa É", "aa É", "aa é", None, "", "x" * 200_000, "X" * 200_000, "solo"]
    df = spark.createDataFrame([(i, t, "k", "n") for i, t in enumerate(texts)], DOCS)
    got = exact_dedup(df, keep=keep, **({"hashed": hashed} if hashed else {})).collect()
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[fold(t)].append(i)
    assert len(got) == len(texts)
    for r in got:
        g = groups[fold(texts[r["doc_id"]])]
        best = min(g) if keep == "smallest" else max(g)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(g), r["doc_id"] == best)
        assert r["text_sha256"] == hashlib.sha256(fold(texts[r["doc_id"]]).encode()).hexdigest()


def test_exact_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(df).collect())
    assert got == Counter({(None, 3, 3, False): 1, (3, 3, 3, True): 2, (None, None, 1, False): 1})
    assert exact_dedup(df.limit(0)).count() == 0


def test_lines(spark):
    texts = {i: f"own {i}\n  Shared LINE\t\n\nsecond {i % 2}" for i in range(6)}
    texts |= {6: None, 7: "", 8: "shared line\nshared line", 9: "É shared line", 10: "\n".join(f"l{k}" for k in range(30_000)) + "\nSHARED line"}
    df = spark.createDataFrame([(i, t, "k", "n") for i, t in texts.items()], DOCS)
    seen = defaultdict(set)
    key = lambda line: fold(line).strip(" \t\n\v\f\r")
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            seen[key(line)].add(i)
    got = line_dedup(df, min_docs=4).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        lines = (texts[r["doc_id"]] or "").split("\n")
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < 4]
        assert (r["text"], r["n_lines"], r["n_dropped"], r["kept"]) == ("\n".join(kept), len(lines), len(lines) - len(kept), "k")


def test_lines_of_repeated_ids_and_empty_table(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (1, "c\na"), (2, "a"), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(r["text"] for r in line_dedup(df, min_docs=3).collect()) == Counter({"b": 2, "c": 1, "": 2})
    assert line_dedup(df.limit(0)).count() == 0


def test_components_of_long_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 400)] + [(500, 500), (7, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({n for e in links for n in e}, links)
    want.pop(500)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_group_roots():
    rng = np.random.default_rng(2)
    i, j = rng.integers(0, 80, (2, 70))
    want = roots(range(80), zip(i.tolist(), j.tolist(), strict=True))
    assert group_roots(80, i, j).tolist() == [want[k] for k in range(80)]


def vectors(rng):
    base = rng.standard_normal((12, 16))
    rows = []
    for k, b in enumerate(base):
        for step in (0.0, 0.02, 0.05, 0.08, 0.2):
            rows.append((len(rows), (b + step * rng.standard_normal(16)).tolist(), k % 3))
    hub = rng.standard_normal(16)
    rows += [(len(rows) + i, (hub + 0.05 * rng.standard_normal(16)).tolist(), 1) for i in range(40)]
    n = len(rows)
    rows += [(n + i, rows[0][1], 0) for i in range(5)]
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [1.0] * 15, rows[0][1][:8], [1e300] * 16, [1e300] * 16]
    rows += [(n + 5 + i, v, 0) for i, v in enumerate(odd)]
    return [*rows, (n + 20, rows[0][1], None), (n + 21, rows[0][1], 2), (2, rows[2][1], 2)]


def test_vectors_against_brute_force(spark):
    rows = vectors(np.random.default_rng(4))
    usable = lambda v, lab: lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if usable(v, lab) else None for _, v, lab in rows]
    links = [
        (i, j) for i, j in combinations(range(len(rows)), 2) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98
    ]
    degree, root = Counter(x for e in links for x in e), roots(range(len(rows)), links)
    lowest = defaultdict(list)
    for k, r in root.items():
        lowest[r].append(rows[k][0])
    want = Counter((rows[k][0], degree[k], min(lowest[root[k]]), rows[k][0] == min(lowest[root[k]])) for k in range(len(rows)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for block_rows in (512, 5):
        got = embedding_dedup(df.withColumn("kept", F.lit("clash")), block_rows=block_rows).collect()
        assert Counter(tuple(r) for r in got) == want
    assert embedding_dedup(df.limit(0)).count() == 0


def test_hash_plan_reaches_its_recall():
    for rows in (10, 10**5, 10**9):
        k, tables = hash_plan(rows, 0.98, 1.6, 1e-6)
        assert (1 - collision(0.2, 1.6) ** k) ** tables <= 1e-6 and rows * collision(2**0.5, 1.6) ** k <= 0.1


def corpus(rng):
    words = [f"w{k}" for k in range(4000)]
    texts, passage = [], " ".join(rng.choice(words, 60))
    for k in range(14):
        base = list(rng.choice(words, 120))
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 3, 4, 6):
            copy = list(base)
            for at in rng.integers(0, 120, edits):
                copy[at] = f"E{k}-{at}"
            texts.append(" ".join(copy))
    texts += [passage + " " + " ".join(rng.choice(words, 50)) for _ in range(40)]
    texts += [texts[0].upper(), texts[0].replace(" ", "\n\t"), None, "", " \n ", "one two three", "ONE two\vthree", "one two", "a b c d e", "long " * 5000 + "end", "long " * 4000 + "end"]
    return texts


def brute_sets(texts):
    out = []
    for t in texts:
        w = fold(t).replace("\v", " ").split() if t else []
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def test_minhash_against_brute_force(spark):
    texts = corpus(np.random.default_rng(6))
    sets = brute_sets(texts)
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root = roots(range(len(texts)), links)
    df = spark.createDataFrame([(i, t, "k", "n") for i, t in enumerate(texts)], DOCS)
    for block_rows in (512, 3):
        got = minhash_dedup(df, block_rows=block_rows).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), root[i], root[i] == i) for i in range(len(texts))}


def test_minhash_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (5, "other words in this row here"), (None, None)]
    got = Counter(tuple(r) for r in minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(None, 2, 5, False): 1, (5, 2, 5, True): 3, (None, 0, None, True): 1})
    assert minhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_guarantees_every_pair_within_its_radius():
    index, rng = Index(), np.random.default_rng(1)
    assert index.miss(0.85) < 1e-4 and index.radius == 21
    for _ in range(300):
        a = rng.integers(0, 256, 64, dtype=np.uint8)
        b = a.copy()
        at = rng.choice(64, index.radius, replace=False)
        b[at] += rng.integers(1, 256, len(at), dtype=np.uint8)
        keys = index.keys(np.stack((a, b)))
        assert (keys[0] == keys[1]).any()


def test_signature_estimates_similarity():
    words = [f"v{k}" for k in range(1200)]
    a, b = shingles(" ".join(words[:1000])), shingles(" ".join(words[:900] + words[1000:1100]))
    real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = (signature(a, 2048) == signature(b, 2048)).mean()
    assert abs(same - real) < 0.05


@pytest.mark.parametrize("how", ["plain", "by_text", "classes"])
def test_a_document_of_very_many_frequent_lines(spark, how):
    """Whole texts are digested once a document, not once a line."""
    text = "\n".join(f"line {k}" for k in range(200_000))
    df = spark.createDataFrame([(i, f"{text}\nown {i}") for i in range(2)] + [(9, "line 1")], "doc_id long, text string")
    classes = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, class long")
    out = line_dedup(df, min_docs=2, **{"plain": {}, "by_text": {"by_text": True}, "classes": {"classes": classes}}[how])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.orderBy("doc_id").collect()] == [(0, 200_001, 200_000, "own 0"), (1, 200_001, 200_000, "own 1"), (9, 1, 1, "")]
    for at, line in enumerate(lines := plan.split("\n")):
        if "Generate" in line:
            above = lines[at - 1]
            assert "Project" not in above or "md5(concat_ws" not in above


def test_lines_counted_by_class(spark):
    df = spark.createDataFrame([(i, f"shared\nown {i}") for i in range(4)] + [(None, "shared")], "doc_id long, text string")
    classes = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "doc_id long, class long")
    dropped = {k: line_dedup(df, min_docs=k, classes=classes).filter("n_dropped > 0").count() for k in (3, 4)}
    assert dropped == {3: 5, 4: 0}  # one class, and ids 3 and null of their own
