"""The stages of the pipeline on copies, near-copies, noise and schedules."""

from __future__ import annotations

import random
import string

from pyspark.sql import functions as F

import corpus_pipeline
from emberline.llm.mixing import mix_schedule

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def clean(i, n=60):
    return " ".join(f"word{i}of{k}" for k in range(n))


def test_one_of_twelve_copies_comes_out(spark, tmp_path):
    texts = {i: f"{clean(i)}\nfooter line" for i in range(11)}
    texts |= {100 + i: f"{clean(50)}\nsecond {clean(51)}" for i in range(10)} | {110: f"{clean(50)} \n\nsecond {clean(51)}", 111: f"{clean(50)}\nSecond {clean(51)}"}
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == set(range(11)) | {100}
    lines = corpus_pipeline.line_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert len(lines) == len(texts) and not any("footer" in r["text"] for r in lines)


def test_near_duplicates_from_80_percent(spark):
    """A tail of k other words leaves (n - k) / (n + k) of n shingles in common."""
    rows, gone = [], set()
    for i in range(12):
        words = clean(i, 94).split()
        for j, k in enumerate((0, 8, 10, 11)):  # 83.7 %, 80 % exactly and 78.2 % of 90 shingles
            rows.append((10 * i + j, " ".join(words[: 94 - k] + [f"tail{i}x{j}x{t}" for t in range(k)]), "en", "s", 0))
        gone |= {10 * i + 1, 10 * i + 2}
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert {r[0] for r in rows} - got == gone
    assert corpus_pipeline.NEAR_INDEX.miss(0.80) < 9e-5


def test_random_letters_go_and_short_clean_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng = random.Random(4)
    noise = {-1 - k: "".join(rng.choice(letters) for _ in range(n)) for k, (n, letters) in enumerate((n, x) for n in (100, 300, 1000, 3000, 10_000) for x in (string.ascii_lowercase, string.ascii_letters + " " * 9) for _ in range(8))}
    short = {-1001: "This is the house that was for sale.", -1002: "Das ist nicht der Weg, den wir gehen.", -1003: "Il est dans la maison avec les enfants.", -1004: "the end of the day", -1005: "and the"}
    more = spark.createDataFrame([(i, t, None, "s", 0) for i, t in (noise | short).items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs.unionByName(more), "").select("doc_id").collect()}
    assert set(short) <= got and not set(noise) & got
    clean_ids = {r["doc_id"] for r in docs.filter(r"text rlike '\\p{L}'").select("doc_id").collect()}
    assert clean_ids <= got
    assert corpus_pipeline.language_stage(spark, docs.filter("doc_id < 3"), "").count() <= 3


def test_bounds_of_bands_without_texts(spark):
    rows = [("a", "x" * n, "a", s) for n, s in ((16, 0.4), (300, 0.8)) for _ in range(20)] + [("b", "x" * 16, "b", 0.1)] * 3
    bounds = corpus_pipeline.language_bounds(spark.createDataFrame(rows, "lang string, text string, lang_pred string, score double"))
    assert bounds["a", 4] == 0.2 and bounds["a", 8] == 0.4 and ("b", 4) not in bounds
    assert bounds[None, 4] == 0.05 and bounds[None, 2] == 0.025 and bounds[None, 6] == 0.2 and bounds[None, 30] == 0.4
    assert set(corpus_pipeline.language_bounds(spark.createDataFrame([], "lang string, text string, lang_pred string, score double")).values()) == {1 / 32}


def test_mixed_files_follow_the_schedule(spark, tmp_path):
    rows = [(i, clean(i, 5000), "en", "big" if i % 4 else "small", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    corpus_pipeline.mixing_stage(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    want = [r["doc_id"] for r in mix_schedule(docs, max_repeats=2.0).orderBy("block", "slot").collect()]
    got = spark.read.parquet(f"{tmp_path}/mixed").select("doc_id", F.input_file_name().alias("file"), F.col("_metadata.row_index").alias("k")).orderBy("file", "k").collect()
    assert len(want) > len(rows) and [r["doc_id"] for r in got] == want


def test_documents_without_labels_stay(spark, tmp_path):
    rows = [(i, clean(i), None, "s", 0) for i in range(20)] + [(50, "123 !", None, "s", 0), (51, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, "").collect()} == set(range(20))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(20))


def test_near_copies_keep_the_lines_they_share(spark):
    """Twelve near-copies of twenty lines, one line of their own each, and a footer that other documents share, too."""
    shared = [clean(k, 28) for k in range(20)]
    rows = [(i, "\n".join([*shared[: i + 1], clean(100 + i, 28), *shared[i + 1 :], "the footer"]), "en", "s", 0) for i in range(12)]
    rows += [(50 + i, f"{clean(200 + i)}\nthe footer", "en", "s", 0) for i in range(10)]
    lines = corpus_pipeline.line_stage(spark, spark.createDataFrame(rows, DOCS), "")
    got = {r["doc_id"]: r for r in lines.collect()}
    assert all(len(got[i]["text"].split()) == 21 * 28 for i in range(12)) and not any("footer" in r["text"] for r in got.values())
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, lines, "").collect()}
    assert kept == {0} | set(range(50, 60))


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(7, clean(1), "en", "s", 0)] * 5 + [(8, clean(2) + " " + "long " * 100_000, "en", "s", 0), (None, clean(3), None, None, None), (None, clean(3), None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("_of", "lang_pred", "score", "band", "kept_id", "class", "h"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    for name, step in corpus_pipeline.STAGES[:4]:
        kept, docs = docs, step(spark, docs, "")
        assert docs.columns[5:] == ["_of", "lang_pred", "score", "band", "kept_id", "class", "h"]
        assert all(r[c] == f"own {c}" for r in docs.collect() for c in docs.columns[5:])
        docs = kept if name == "language_id" else docs  # three texts are too few to tell languages by
    assert sorted({r["doc_id"] or 0 for r in docs.collect()}) == [0, 7, 8]
