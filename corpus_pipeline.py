"""From raw documents to packed training sequences: five stages, each written as Parquet before the next reads it.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``docs``, except the last, which returns pieces. Rows
with null ids pass through as each operator defines; null and empty texts go with the language stage, all but one of repeated rows (same id
and text) with the near-duplicate stage; an empty table stays empty.
"""

from __future__ import annotations

import random
import string

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import free_name, replacing, text_or_empty
from emberline.llm.language_id import fit_languages, held_out, predict_language
from emberline.llm.line_dedup import line_dedup
from emberline.llm.minhash_dedup import Index, minhash_dedup
from emberline.llm.mixing import mix_documents
from emberline.llm.near_classes import near_classes
from emberline.llm.packing import pack
from emberline.plans.staging import stage, unstage

#: Least cosine where no labelled text tells more: one standard deviation of random vectors of 1,024 places.
NOISE = 1 / 32

#: A text passes with this share of the cosine that all but LOW of its language's labelled texts of like length reach;
#: fewer than ENOUGH texts say nothing of their own.
SHARE, LOW, ENOUGH = 0.5, 0.01, 20

#: And no text need pass this many times the largest cosine of 100 texts of random letters of its length, up to 2 ** 14 letters.
OVER, BANDS = 1.25, 31
RANDOM_TEXTS, RANDOM_BANDS = 100, 14

#: Percent of common shingles that make a near-duplicate, and an index whose radius misses a pair just there with 5e-5.
NEAR, NEAR_INDEX = 80, Index(symbols=75, chunks=15)


#: Rows of an Arrow batch. A batch of texts stands in memory several times over, in the executor and in its Python worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def letter_band(text: Column) -> Column:
    """Number of letters as a power of two, rounded down."""
    letters = F.char_length(F.regexp_replace(text_or_empty(text), r"\P{L}+", ""))
    return F.floor(F.log2(F.greatest(letters, F.lit(1)))).cast("int")


def language_bounds(scored: DataFrame) -> dict[tuple[str | None, int], float]:
    """Least cosine by language and letter band, from labelled texts that the prototypes have not seen.

    Only texts placed in their own language count. A language with few texts in a band takes the bound of all languages
    (key None); a band with few texts at all takes that of the next longer one, less by the root of the length as cosines of
    short texts are, or else of the next shorter one. At most 31 numbers a language reach the driver.
    """
    own = scored.filter(F.col("lang_pred") == F.col("lang").cast("string")).select("lang_pred", letter_band(F.col("text")).alias("band"), "score")
    own = own.select(F.explode(F.array(F.col("lang_pred"), F.lit(None).cast("string"))).alias("key"), "band", "score")
    rows = own.groupBy("key", "band").agg(F.percentile_approx("score", LOW, 10_000).alias("low"), F.count(F.lit(1)).alias("n")).collect()
    bounds = {(r["key"], r["band"]): SHARE * r["low"] for r in rows if r["n"] >= ENOUGH}
    for band in range(BANDS):
        if (None, band) not in bounds:
            longer, shorter = ([b for k, b in bounds if k is None and (b > band) == up] for up in (True, False))
            bounds[None, band] = bounds[None, min(longer)] * 2 ** ((band - min(longer)) / 2) if longer else bounds[None, max(shorter)] if shorter else NOISE
    return bounds


def random_bounds(spark: SparkSession, prototypes: dict[str, list[float]]) -> list[float]:
    """Cosine by letter band that texts of random letters, half of them with spaces, stay below."""
    rng, texts = random.Random(7), []
    for band in range(RANDOM_BANDS):
        for k in range(RANDOM_TEXTS):
            texts.append((band, "".join(rng.choices(string.ascii_lowercase + " " * (k % 2 * 5), k=3 << band >> 1 or 1))))
    scored = predict_language(spark.createDataFrame(texts, "doc_id long, text string"), prototypes)
    most = {r["doc_id"]: r["most"] for r in scored.groupBy("doc_id").agg(F.max("score").alias("most")).collect()}
    return [OVER * most[min(band, RANDOM_BANDS - 1)] for band in range(BANDS)]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those no nearer to any language than noise; short clean ones stay.

    Noise is what lies both under ``language_bounds`` and under ``random_bounds``. Without labelled rows to learn from, every
    document with a letter stays.
    """
    small_batches(spark)
    seen = ~held_out(F.col("doc_id"))
    prototypes = fit_languages(docs.filter(seen))
    if not prototypes:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    bounds = language_bounds(predict_language(docs.filter(~seen & F.col("lang").isNotNull()), prototypes))
    most = random_bounds(spark, prototypes)
    least = spark.createDataFrame([(k, b, min(most[b], bounds.get((k, b), bounds[None, b]))) for k in prototypes for b in range(BANDS)], "lang string, band int, lowest double")
    # Columns have plain names meanwhile, so that none has a name that the operator or the bounds use.
    plain = ["text" if c == "text" else f"_d{k}" for k, c in enumerate(docs.columns)]
    scored = predict_language(docs.toDF(*plain), prototypes).withColumn("length", letter_band(F.col("text")))
    held = scored.join(F.broadcast(least), (F.col("lang_pred") == F.col("lang")) & (F.col("length") == F.col("band")))
    return held.filter(F.col("score") >= F.col("lowest")).select(plain).toDF(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more share, near-duplicates counted as one; documents left with no text go.

    So a text keeps the lines it shares with its copies only, and the next stage keeps one copy whole. ``n_chars`` follows the text.
    DataFrame operations only.
    """
    out = line_dedup(docs, min_docs=10, classes=near_classes(docs, percent=NEAR)).filter("text <> ''").select(docs.columns)
    if "n_chars" in docs.columns:
        out = replacing(out, {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)}).select(docs.columns)
    return out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id; without shingles a document stays.

    Of rows that repeat an id and text one stays, too.
    """
    small_batches(spark)
    name = free_name(docs, "kept_id")
    kept = minhash_dedup(docs.select("doc_id", "text"), percent=NEAR, index=NEAR_INDEX).filter("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the tempered weight of its source asks: once at least, twice at most.

    Rows are written in the order of the schedule's blocks and slots, so each file holds a run of it, and so does what is packed.
    """
    mixed = mix_documents(docs, max_repeats=2.0).select(*[F.col(f"`{c}`").alias(f"_d{k}") for k, c in enumerate(docs.columns)], "block", "slot")
    ordered = mixed.repartitionByRange("block", "slot").sortWithinPartitions("block", "slot")
    return ordered.select(*[F.col(f"_d{k}").alias(c) for k, c in enumerate(docs.columns)])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens."""
    small_batches(spark)
    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("minhash_dedup", near_duplicate_stage),
    ("mix_sources", mixing_stage),
    ("pack", packing_stage),
]

#: Language vectors and tokens cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: DataFrame | None = None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
