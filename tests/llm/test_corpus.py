"""Sharding, languages, mixing, licences, the pipeline, and queries beside their SQL."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberline.llm.catalog import ORACLES, QUERIES
from emberline.llm.language_id import fit_languages, predict_language
from emberline.llm.license_scan import TEMPLATES, bands_for, license_scan
from emberline.llm.mixing import entropy, mix_documents, mix_schedule, plan_mix
from emberline.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards

SMALL = "/root/testdata/sf0.001"


def test_hypergeometric_has_the_right_moments():
    import random

    rng = random.Random(1)
    for good, bad, n in ((30, 70, 20), (5, 3, 6), (10**11, 10**12, 5000)):
        draws = np.array([hypergeometric(rng, good, bad, n) for _ in range(4000)])
        total, p = good + bad, good / (good + bad)
        sd = math.sqrt(n * p * (1 - p) * (total - n) / (total - 1))
        assert draws.min() >= max(0, n - bad) and draws.max() <= min(good, n)
        assert abs(draws.mean() - n * p) < 5 * sd / math.sqrt(len(draws)) and abs(draws.std() / sd - 1) < 0.08


def test_matrix_sums():
    counts, sizes = [7, 0, 12, 1, 20], [10, 10, 10, 10]
    m = communication_matrix(counts, sizes, 3)
    assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m, strict=True)] == sizes


def test_shards_are_even_and_slots_gapless(spark):
    df = spark.range(1003).select(F.when(F.col("id") < 300, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("slot")).repartition(5)
    got = shuffle_into_shards(df, shards=7, block_rows=50).collect()
    assert len(got) == 1003 and Counter(r["doc_id"] for r in got)[5] == 300
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(map(len, by.values())) in ([143] * 5 + [144] * 2,) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert shuffle_into_shards(df.limit(0), shards=7).count() == 0


def test_shuffle_is_uniform(spark):
    """Neighbours in the input land in each shard and each half of it equally often."""
    got = shuffle_into_shards(spark.range(4000).repartitionByRange(4, "id"), shards=4).collect()
    for low in range(0, 4000, 1000):
        n = Counter((r["shard"], r["slot"] >= 500) for r in got if low <= r["id"] < low + 1000)
        assert len(n) == 8 and all(80 < v < 170 for v in n.values())


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98


def test_language_of_odd_texts(spark):
    learn = spark.createDataFrame([("a", "abc abd abe"), ("b", "xyz xyw"), (None, "qqq"), ("c", None)], "lang string, text string")
    prototypes = fit_languages(learn)
    assert sorted(prototypes) == ["a", "b"]
    rows = [(1, "ABC", 0), (2, None, 0), (3, "", 0), (4, "123 !?", 0), (5, "xyz " * 100_000, 0), (5, "xyz " * 100_000, 0), (None, "\x00abc퟿", 0)]
    got = predict_language(spark.createDataFrame(rows, "doc_id long, text string, score int"), prototypes).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in got] == [(1, "a"), (2, "und"), (3, "und"), (4, "und"), (5, "b"), (5, "b"), (None, "a")]
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in predict_language(spark.createDataFrame(rows, "doc_id long, text string, score int"), {}).collect()} == {"und"}
    assert fit_languages(learn.limit(0)) == {} and predict_language(spark.createDataFrame([], "doc_id long, text string"), prototypes).count() == 0


def test_temperature():
    tokens = [900, 90, 10]
    assert plan_mix(tokens, 1.0, None, 1000).weights == pytest.approx([1 / 3] * 3, abs=1e-4)
    mix = plan_mix(tokens, 0.7, None, 1000)
    assert entropy(mix.weights) == pytest.approx(0.7 * math.log(3), abs=1e-9) and sum(mix.budgets) == pytest.approx(1000, abs=2)
    mix = plan_mix(tokens, None, 3.0, None)
    assert max(b / t for b, t in zip(mix.budgets, tokens, strict=True)) == pytest.approx(3, abs=0.06) and mix.budgets[0] == 900
    assert plan_mix(tokens, 1.0, 2.0, None).exponent == plan_mix(tokens, None, 2.0, None).exponent


def test_mix_realises_its_budgets(spark):
    rows = [(i, "w " * (i % 9), "big" if i % 4 else "small", 0) for i in range(400)] + [(None, None, None, 0), (7, "w " * 7, "big", 0), (900, "w", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    uses = mix_schedule(df, max_repeats=2.0, block_tokens=200).collect()
    size, used = Counter(), Counter()
    for i, t, s, _ in {(i, t, s, 0) for i, t, s, _ in rows}:
        size[s] += len((t or "").split()) + 1
    for r in uses:
        used[r["source"]] += r["tokens"]
    assert used["big"] == size["big"] and all(size[s] <= used[s] <= 2 * size[s] for s in size)
    assert {r["doc_id"] for r in uses} == {i for i, *_ in rows}
    for b in {r["block"] for r in uses}:
        assert sorted(r["slot"] for r in uses if r["block"] == b) == list(range(sum(r["block"] == b for r in uses)))
    mixed = mix_documents(df, max_repeats=2.0)
    assert mixed.columns == ["doc_id", "text", "source", "pass", "block", "slot"] and mixed.count() == len(uses) + 1
    assert mix_schedule(df.limit(0)).count() == 0 and mix_documents(df.limit(0)).count() == 0


def test_licences(spark):
    assert (1 - 1 / 4) ** bands_for(1e-6) <= 1e-6
    name, long = TEMPLATES[4]
    words = long.split()
    edited = " ".join(words[:14] + ["changed"] + words[15:])
    rows = [
        (1, f"before words {long} after", "x"), (2, f"{edited}", "x"), (3, "Released  under\nTHE mit license", "x"), (4, None, "x"), (5, "", "x"), (6, "too short", "x"),
        (7, " ".join(words[:12]), "x"), (8, ("filler " * 40_000) + TEMPLATES[0][1], "x"), (9, f"{TEMPLATES[3][1]} {'w ' * 30} {TEMPLATES[3][1]}", "x"), (9, f"{TEMPLATES[3][1]} {'w ' * 30} {TEMPLATES[3][1]}", "x"), (None, TEMPLATES[3][1], "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, template string")
    got = Counter((r["doc_id"], r["template"]) for r in license_scan(df).collect())
    assert got == Counter({(1, name): 1, (2, name): 1, (3, "MIT"): 1, (8, "Apache-2.0"): 1, (9, "MIT"): 2, (None, "MIT"): 1})
    assert license_scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = QUERIES[name](spark, SMALL).toPandas()
    want = con.sql(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert Counter(map(tuple, got[cols].values.tolist())) == Counter(map(tuple, want[cols].values.tolist()))


def test_every_stage_works_on_what_the_one_before_kept(spark, tmp_path):
    clean = {i: " ".join(f"word{i}of{k}" for k in range(60)) for i in range(40)}
    texts = clean | {100: None, 101: "12 34", 102: clean[3], 103: clean[4] + " tail", 104: ""}
    texts = {i: t + "\nfooter line" if t and i < 12 else t for i, t in texts.items()}
    rows = [(i, t, "en" if t else None, f"s{i % 3}", 0) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    kept = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SMALL)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    assert {r["doc_id"] for r in kept["language_id"]} == set(texts) - {100, 101, 104}
    assert not any("footer" in r["text"] for r in kept["line_dedup"]) and len(kept["line_dedup"]) == len(kept["language_id"])
    assert {r["doc_id"] for r in kept["minhash_dedup"]} == set(clean)
    assert {r["doc_id"] for r in kept["mix_sources"]} == set(clean)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r["doc_id"] for r in pieces} == set(clean) and all(r["length"] <= 2048 for r in pieces)
    empty = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, SMALL).count() == 0
