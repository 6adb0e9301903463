"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.embedding_dedup import embedding_dedup
from emberline.llm.exact_dedup import exact_dedup
from emberline.llm.common import text_or_empty
from emberline.llm.interpolated_lm import interpolated_scores
from emberline.llm.language_id import fit_languages, held_out, predict_language
from emberline.llm.license_scan import TEMPLATES, license_scan
from emberline.llm.line_dedup import line_dedup
from emberline.llm.minhash_dedup import minhash_dedup
from emberline.llm.mixing import mix_schedule
from emberline.llm.packing import pack
from emberline.llm.prefix_trie import prefix_trie
from emberline.llm.sharding import shuffle_into_shards
from emberline.llm.vector_codes import codebooks_digest, vector_codes
from emberline.llm.wavelet import read_documents, write_token_shards
from emberline.plans.staging import stage_path

Query = Callable[[SparkSession, str], DataFrame]
BPE = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(documents(spark, sf_dir), BPE)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "piece_cost", "sequence_cost")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.98)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir), percent=80)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(documents(spark, sf_dir), percent=85)


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty("text")
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffle_into_shards(rows, shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out(F.col("doc_id")))
    prototypes = fit_languages(docs.filter(~F.col("held_out")))
    return predict_language(docs.select("doc_id", "held_out", "text"), prototypes).drop("text")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_schedule(documents(spark, sf_dir), max_repeats=2.0).drop("key").withColumn("weight", F.round("weight", 9))


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "token-shards")
    write_token_shards(documents(spark, sf_dir), path, BPE)
    return read_documents(spark, path, checksums=True)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_scores(documents(spark, sf_dir), order=2)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=8, entries=16, rounds=6, scale=4096)
    return codes.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), group=5, most=8)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_pack, op2_embedding_dedup, op3_license_scan, op4_line_dedup, op5_minhash_dedup, op6_shard, op7_language_id, op8_mix, op9_wavelet, op10_exact_dedup, op11_lm_score, op12_vector_codes, op13_prefix_trie)}


# Unsigned CRC-32 of an ASCII string: eight shifts a byte, by the reflected polynomial.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda s: ascii(s)::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def vector_codes_sql(rounds: int = 6) -> str:
    """Assignments and floored means, one pair of subqueries a round."""

    def assigned(k: int) -> str:
        dist = "CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
        return f"a{k} AS (SELECT vec_id, label, p, x, min({{'dist': {dist}, 'e': e}}) AS best FROM parts JOIN b{k} USING (p) GROUP BY vec_id, label, p, x)"

    steps = []
    for k in range(rounds):
        steps += [
            assigned(k),
            f"""s{k} AS (
  SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT p, best.e AS e, x, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY p, e, i)""",
            f"m{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{k} GROUP BY p, e)",
            f"b{k + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (p, e))",
        ]
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))),
parts AS (SELECT vec_id, label, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS x FROM kept, range(8) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, x) - 1 AS e, x AS c FROM parts QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id, x) <= 16),
{(',' + chr(10)).join(steps)},
{assigned(rounds)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.dist) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(y, ',' ORDER BY p, e, i)) AS d FROM (SELECT p, e, CAST(unnest(c) AS VARCHAR) AS y, generate_subscripts(c, 1) AS i FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, d AS codebooks_sha256 FROM coded, digest"""


# A-Z only, in either engine.
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op12_vector_codes": vector_codes_sql(),
    "op13_prefix_trie": f"""
WITH numbered AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT c, {CRC32.format("CAST(c AS VARCHAR)")} % 9 AS h FROM numbered),
rebuilt AS (
  SELECT v.c, 0 AS part, b.pos, b.role, b.text FROM convs v JOIN numbered b ON b.c = v.c - v.c % 5 AND b.pos <= v.h
  UNION ALL SELECT c, 1, pos, role, text FROM numbered JOIN convs USING (c) WHERE pos > h),
sequences AS (
  SELECT v.c, coalesce(list({{'role': r.role, 'text': r.text}} ORDER BY part, pos) FILTER (r.c IS NOT NULL), []) AS turns
  FROM convs v LEFT JOIN rebuilt r ON v.c = r.c GROUP BY v.c),
ways AS (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM sequences),
-- a node is known by its smallest member and its depth
paths AS (SELECT c, d, min(c) OVER (PARTITION BY d, turns[1:d]) AS m, d = len(turns) AS ends, CASE WHEN d = 0 THEN 0 ELSE strlen(turns[d].text) END AS bytes FROM ways),
nodes AS (SELECT m, d, count(*) AS n, max(bytes) AS bytes, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends) AS ids FROM paths GROUP BY m, d),
upward AS (SELECT x.*, p.m AS up FROM nodes x LEFT JOIN paths p ON p.c = x.m AND p.d = x.d - 1),
children AS (SELECT up AS m, d - 1 AS d, count(*) AS k FROM upward WHERE up IS NOT NULL GROUP BY up, d),
totals AS (
  SELECT p.m, p.d, count(*) FILTER (k IS NULL) AS leaves, sum((x.n - 1) * x.bytes) AS saved
  FROM nodes x LEFT JOIN children k ON x.m = k.m AND x.d = k.d JOIN paths p ON p.c = x.m AND p.d <= x.d GROUP BY p.m, p.d)
SELECT u.m AS conv_id, u.d AS depth, up AS parent_conv_id, n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM upward u JOIN totals USING (m, d) LEFT JOIN children c ON u.m = c.m AND u.d = c.d""",
    "op2_embedding_dedup": """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
lowest AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degrees AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN lowest l ON e.vec_id = l.x LEFT JOIN degrees d ON e.vec_id = d.x""",
    "op8_mix": """
WITH RECURSIVE words AS (
  SELECT doc_id, source, text, 1 + len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS tokens FROM documents),
totals AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS total FROM words GROUP BY source),
largest AS (SELECT max(total) AS most, min(total) AS least FROM totals),
-- without a budget, a source repeats as often as (its tokens / the most tokens) to the power (exponent - 1)
halvings(k, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN fits THEN low ELSE mid END, CASE WHEN fits THEN mid ELSE high END
  FROM (SELECT k, low, high, (low + high) / 2 AS mid, power(least::DOUBLE / most, (low + high) / 2 - 1) <= 2.0 AS fits FROM halvings, largest WHERE k < 60)),
chosen AS (SELECT CASE WHEN power(least::DOUBLE / most, -1.0) <= 2.0 THEN 0.0 ELSE high END AS exponent FROM halvings, largest WHERE k = 60),
plan AS (
  SELECT t.source, total, CAST(round(power(total::DOUBLE / most, exponent - 1) * total) AS BIGINT) AS budget,
    power(total::DOUBLE, exponent) / sum(power(total::DOUBLE, exponent)) OVER () AS weight
  FROM totals t, largest, chosen),
uses AS (
  SELECT w.doc_id, w.source, w.tokens, p.total, p.budget, p.weight, CAST(g.i AS INTEGER) AS pass,
    concat_ws('|', g.i, w.doc_id, upper(md5(concat_ws(chr(10), w.doc_id, coalesce(w.text, ''))))) AS tag
  FROM words w JOIN plan p ON w.source IS NOT DISTINCT FROM p.source, range(0, 3) g(i) WHERE g.i * p.total < p.budget),
placed AS (
  SELECT *, pass * total + sum(tokens) OVER (PARTITION BY source, pass ORDER BY md5('3|' || tag) ROWS UNBOUNDED PRECEDING) AS ends FROM uses),
kept AS (
  SELECT *, CAST(floor((ends - tokens)::DOUBLE * (SELECT greatest(1, CAST(ceil(sum(budget) / 1048576.0) AS BIGINT)) FROM plan) / budget) AS BIGINT) AS block
  FROM placed WHERE ends <= budget)
SELECT doc_id, source, CAST(tokens AS BIGINT) AS tokens, pass, block, row_number() OVER (PARTITION BY block ORDER BY md5('slot|3|' || tag)) - 1 AS slot, round(weight, 9) AS weight
FROM kept""",
    "op3_license_scan": f"""
WITH texts AS (
  SELECT NULL AS name, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT name, NULL, text FROM (VALUES {", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in TEMPLATES)}) v(name, text)),
words AS (SELECT name, doc_id, list_filter(regexp_split_to_array({LOWERED.format("text")}, '[^\\pL\\pN]+'), lambda w: w <> '') AS w FROM texts),
shingles AS (
  SELECT name, doc_id, unnest(range(0, len(w) - 4)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) AS s
  FROM words WHERE len(w) >= 5),
parts AS (SELECT DISTINCT name, s, count(DISTINCT s) OVER (PARTITION BY name) AS n_template FROM shingles WHERE name IS NOT NULL),
placed AS (SELECT d.doc_id, p.name, d.pos, d.s, p.n_template FROM shingles d JOIN parts p ON d.s = p.s WHERE d.name IS NULL),
cut AS (SELECT *, pos - lag(pos) OVER (PARTITION BY doc_id, name ORDER BY pos) > greatest(4, ceil(n_template / 4)) AS new FROM placed),
runs AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, name ORDER BY pos) AS part FROM cut)
SELECT doc_id, name AS template, CAST(min(pos) AS INTEGER) AS first_word, CAST(max(pos) + 4 AS INTEGER) AS last_word, count(DISTINCT s) AS n_found, any_value(n_template) AS n_template
FROM runs GROUP BY doc_id, name, part HAVING count(DISTINCT s) * 100 >= any_value(n_template) * 80""",
    "op4_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT doc_id, pos, line, trim({LOWERED.format("line")}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key GROUP BY doc_id""",
    "op5_minhash_dedup": f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 85 * (n + m - k)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a),
lowest AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN lowest ON doc_id = x""",
    "op10_exact_dedup": f"""
WITH t AS (SELECT doc_id, {LOWERED.format("coalesce(text, '')")} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t""",
}
