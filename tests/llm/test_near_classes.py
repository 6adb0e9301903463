"""Near-duplicate classes in DataFrame operations against brute force, and the line stage without Python on the executors."""

from __future__ import annotations

import random
import re
from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline
from emberline.llm import near_classes as module
from emberline.llm.near_classes import Bands, near_classes

DOCS = "doc_id long, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def expected(rows, percent):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if sets[k] and i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    out = {}
    for k, (i, _) in enumerate(rows):
        if sets[k]:
            c = least.get(top(k))
            out[i] = c if out.get(i) is None else out[i] if c is None else min(c, out[i])
    return out


def odd_rows():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for _ in range(12):  # chains: each text changes some words of the one before
        words = [word() for _ in range(120)]
        for step in range(8):
            rows.append((len(rows) * 7 % 997, " ".join(words)))
            for _ in range(step % 4):
                words[rng.randrange(len(words))] = word()
    common = [word() for _ in range(60)]
    rows += [(2000 + k, " ".join(common + [word() for _ in range(k)])) for k in range(60)]
    rows += [(3000, None), (3001, ""), (3002, " \t\n\x0b\f\r"), (3003, "One two"), (3004, "\tone  TWO\n"), (3005, "one two three"), (3006, "Éa b"), (3007, "éa b"), (3008, "a b c"), (3009, "a b c")]
    rows += [(3010, "x y z q r s"), (3010, "other text of six words here"), (3011, "OTHER text of six words here"), (None, "one two"), (None, "only null has it"), (3012, "a " * 5000), (3013, "a a a a a a")]
    return rows


def test_classes_against_brute_force(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, DOCS)
    for percent, block_rows in ((80, 512), (85, 4)):
        got = {r["doc_id"]: r["class"] for r in near_classes(df, percent=percent, block_rows=block_rows).collect()}
        assert got == expected(rows, percent)
    assert near_classes(df.limit(0)).count() == 0


def test_distant_copies_of_one_text_do_not_meet_in_pairs(spark, monkeypatch):
    rng = random.Random(3)
    text = [f"c{k}" for k in range(150)]
    rows = []
    for i in range(300):
        words = text.copy()
        for at in rng.sample(range(150), i % 8):
            words[at] = f"w{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    pairs = []

    def counted(df, name):
        out = stage(df, name)
        if out.columns == ["a", "b"]:
            pairs.append(out.count())
        return out

    stage = module.stage
    monkeypatch.setattr(module, "stage", counted)
    got = {r["doc_id"]: r["class"] for r in near_classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == expected(rows, 80)
    assert len(set(got.values())) > 100 and max(pairs) < 3 * len(rows)


def test_chances_of_a_miss():
    shape = Bands()
    assert shape.miss(0.80) < 5e-5 and shape.least(0.80) < 0.80 * shape.symbols
    assert Bands(1, 1).miss(0.5) == 0.5 and Bands(2, 1).least(0.5, 0.3) == 1


def test_line_stage_runs_no_python_on_the_executors(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"own line {i}\nthe footer") for i in range(12)], DOCS)

    def forbidden(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(df), name, forbidden)
    got = corpus_pipeline.line_stage(spark, df, "")
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(i, f"own line {i}") for i in range(12)}
    assert got.filter(F.col("text").contains("footer")).count() == 0
