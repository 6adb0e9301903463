"""Interpolated n-gram scores against a plain version of the same model."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm.interpolated_lm import END, interpolated_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(s):
    return zlib.crc32(s.encode())


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [END]


def grams(words):
    padded = ["<", "<", *words]
    return [tuple(padded[i : i + 3]) for i in range(len(words))]


class Counts:
    def __init__(self, texts, order=3):
        self.order = order
        self.c3 = Counter(g for t in texts for g in grams(t))
        self.c2, self.c1, self.x2, self.x1 = Counter(), Counter(), Counter(), Counter()
        for (a, b, c), n in self.c3.items():
            self.c2[b, c] += n
            self.c1[c] += n
            self.x2[a, b] += n
            self.x1[b] += n
        self.n, self.v = sum(self.c1.values()), len(self.c1)

    def shares(self, g):
        a, b, c = g
        # without triples there is nothing to divide by the count of a pair, which still tells the bucket
        x2, x1 = self.x2[a, b], self.x1[b]
        p = [self.c3[g] / x2 if x2 and self.order == 3 else 0, self.c2[b, c] / x1 if x1 else 0, self.c1[c] / self.n if self.n else 1.0, 1 / (self.v + 1)]
        return np.array(p), (x2.bit_length(), x1.bit_length())


def plain(rows, order=3, rounds=12, gain=1e-4):
    texts = [(None if i is None else str(i), tokens(t)) for i, t in rows]
    held = [i is not None and crc(i) % 7 == 2 for i, _ in texts]
    dev = [not h and i is not None and crc("weights " + i) % 10 == 0 for (i, _), h in zip(texts, held)]
    full = Counts([t for (_, t), h in zip(texts, held) if not h], order)
    main = Counts([t for (_, t), h, d in zip(texts, held, dev) if not h and not d], order)
    places = [main.shares(g) for (_, t), d in zip(texts, dev) if d for g in grams(t)]

    def allowed(key):
        return np.array([key[0] > 0 and order == 3, key[1] > 0, True, True], float)

    found, last = {}, -math.inf

    def weights(key):
        w = found.get(key) if found else allowed(key)
        if w is None:
            wide = sum((e for k, e in sums.items() if k[0] == key[0]), np.zeros(4))
            w = (wide if wide.sum() else sum(sums.values())) + 1
        elif found:
            w = w + 1
        w = w * allowed(key)
        return w / w.sum()

    sums = {}
    for _ in range(rounds if places else 0):
        new, fit = {}, 0.0
        for p, key in places:
            part = p * weights(key)
            new[key] = new.get(key, np.zeros(4)) + part / part.sum()
            fit += math.log10(part.sum())
        found = sums = new
        fit /= len(places)
        if fit - last < gain:
            break
        last = fit
    out = []
    for (i, t), h in zip(texts, held):
        score = 0.0
        for g in grams(t):
            p, key = full.shares(g)
            score += math.log10(p @ weights(key))
        base = sum(math.log10((full.c1[w] + 1) / (full.n + full.v + 1)) for w in t)
        out.append((i, h, len(t), sum(full.c1[w] > 0 for w in t), full.n, base, score))
    return out


def corpus():
    rng = np.random.default_rng(4)
    words = np.array(["The", "cat", "saw", "a", "dog", "É", "and", "sat", "on", "mats", "\x1c", "x y"])
    rows = []
    for i in range(120):
        n = int(rng.integers(1, 40))
        rows.append((i, " ".join(words[np.minimum(rng.geometric(0.3, n) - 1, 11)])))
    long = " ".join(words[rng.integers(0, 12, 900)])
    return [*rows, (120, None), (121, ""), (122, " \t\n"), (123, long), (123, long), (124, rows[3][1]), (None, "the cat\tsaw"), (None, None)]


def table(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, row int, kind string")
    return df.repartition(parts).withColumn("block", F.lit(0)).withColumn("score", F.lit(0.0))


def as_rows(df):
    return sorted(((None if r.doc_id is None else str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_tokens, order", [(2, 3), (37, 3), (1 << 20, 3), (50, 2)])
def test_scores_equal_the_plain_model(spark, block_tokens, order):
    rows = corpus()
    got, want = as_rows(interpolated_scores(table(spark, rows), block_tokens=block_tokens, order=order)), sorted(plain(rows, order), key=repr)
    assert len(got) == len(rows)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_held_out_texts_are_predicted_better_than_by_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = interpolated_scores(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).collect()[0]
    assert r[0] > r[1] * 0.9


def test_probabilities_of_a_context_add_up_to_one():
    texts = [tokens(t) for _, t in corpus()]
    c = Counts(texts[:60])
    for context in [("<", "<"), ("the", "cat"), ("never", "the"), ("never", "seen")]:
        total = sum(c.shares((*context, w))[0] for w in c.c1) + np.array([0, 0, 0, 1 / (c.v + 1)])
        present = np.array([c.x2[context] > 0, c.x1[context[1]] > 0, True, True], float)
        assert total == pytest.approx(present)


def test_empty_and_unlearned_tables(spark):
    empty = table(spark, corpus()).limit(0)
    assert interpolated_scores(empty).collect() == []
    alone = next(i for i in range(100) if crc(str(i)) % 7 == 2)
    (r,) = interpolated_scores(table(spark, [(alone, "a b")])).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)
