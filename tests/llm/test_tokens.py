"""Encoding, packing and token files: exact round trips."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberline.llm.packing import assign, pack
from emberline.llm.tokens import Encoder
from emberline.llm.wavelet import WaveletMatrix, read_documents, token_counts, token_places, write_token_shards

BPE = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(BPE)
PLAIN.encode_special_tokens = True
ENCODER = Encoder(BPE, cache_words=50)
TEXTS = [None, "", " ", "  ", "a  b", " a\n b \n c ", "x   y", "don't   stop <|endoftext|> \x1c \x1e x", "É  é\t\tz  ", "wörter " * 3000, "y" * 30_000, "the end.\n\n", "the end.\n\n"]


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sé1. \n\t\r\x1c  <|>世"), max_size=25), min_size=1, max_size=6))
def test_cut_texts_have_the_ids_of_whole_ones(texts):
    assert [np.frombuffer(b, "<u4").tolist() for b in ENCODER.encode(texts)] == [ids(t) for t in texts]


def rows(spark):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "null id", 7), (3, "again", 7)], "doc_id long, text string, offset int").repartition(3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=40))
def test_assignment_fills_sequences(lengths):
    pieces, costs = assign(lengths, 16, 1.0, 1 / 16)
    used, seen = np.zeros(len(costs), int), {d: [] for d in range(len(lengths))}
    for d, start, n, s in pieces:
        used[s] += n
        seen[d].append((start, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[d]):
            assert start == at and k > 0
            at += k
        assert at == n
    assert (used <= 16).all() and (used > 0).all() and 16 * len(costs) - sum(lengths) < 16


def test_assignment_balances_cost():
    rng = np.random.default_rng(3)
    _, costs = assign([int(x) for x in rng.integers(20, 400, 600)], 2048, 1.0, 1 / 2048)
    assert np.std(costs[:-1]) < 0.05 * np.mean(costs)


def test_pack_keeps_every_id_once(spark):
    got = pack(rows(spark), BPE, capacity=64, block_tokens=2000).collect()
    want = [ids(t) + [1] for t in TEXTS] + [ids("null id") + [1], ids("again") + [1]]
    assert sum(r["length"] for r in got) == sum(map(len, want))
    for key in (5, None, 9):
        own = sorted((r["start"], r["ids"]) for r in got if r["doc_id"] == key)
        assert np.frombuffer(b"".join(x for _, x in own), "<u4").tolist() == (ids("null id") if key is None else ids(TEXTS[key])) + [1]
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 64
    assert pack(rows(spark).limit(0), BPE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=1500), st.integers(0, 45))
def test_wavelet_matrix(values, symbol):
    a = np.array(values, np.int64)
    m = WaveletMatrix.build(a, 6)
    assert m.decode().tolist() == values
    assert m.rank(symbol) == values.count(symbol) and m.rank(symbol, len(values) // 2) == values[: len(values) // 2].count(symbol)
    assert m.occurrences(symbol) == [i for i, v in enumerate(values) if v == symbol]
    assert [m.access(i) for i in range(0, len(values), 97)] == values[::97]


def test_token_files(spark, tmp_path):
    path = str(tmp_path / "shards")
    write_token_shards(rows(spark), path, BPE, segment_tokens=500)
    docs = [(None, "null id"), *[(i, t) for i, t in enumerate(TEXTS)]]
    docs.insert(5, (3, "again"))
    got = read_documents(spark, path).collect()
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [d for d, _ in docs]
    stream = []
    for r in got:
        assert r["start"] == len(stream) and r["n_tokens"] == len(r["ids"]) // 4
        stream += np.frombuffer(r["ids"], "<u4").tolist()
    assert sorted(zlib.crc32(r["ids"]) for r in got) == sorted(zlib.crc32(np.array(ids(t) + [0], "<u4").tobytes()) for _, t in docs)
    for token in (0, 198, 50_000):
        assert sum(r["n"] for r in token_counts(spark, path, token).collect()) == stream.count(token)
        assert sorted(r["place"] for r in token_places(spark, path, token).collect()) == [i for i, v in enumerate(stream) if v == token]


def test_token_files_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    write_token_shards(rows(spark).limit(0), path, BPE)
    assert read_documents(spark, path).count() == 0


def test_too_few_bits(spark, tmp_path):
    with pytest.raises(Exception, match="needs more than 8 bits"):
        write_token_shards(rows(spark), str(tmp_path / "small"), BPE, bits=8)


def test_checksums_equal_texts_and_other_ids(spark, tmp_path):
    """Texts of one id or none are spread over shards; ids of any type; checksums are those of the decoded ids."""
    rows = [(None, f"text {i}") for i in range(300)] + [(7, "same")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast("decimal(10,2)"))
    path = str(tmp_path / "shards")
    write_token_shards(df, path, BPE)
    whole = read_documents(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    assert sorted(whole.collect(), key=str) == sorted(read_documents(spark, path, checksums=True).collect(), key=str)
    assert sum(1 for r in whole.collect() if r.doc_id == 7) == 5
    assert pack(df, BPE).count() >= len(rows)
