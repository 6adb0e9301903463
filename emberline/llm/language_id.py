"""Language identification by hyperdimensional n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.session import ship_package

UNDETERMINED = "und"
SPACE = 0x20


class Profiles:
    """Trigram vectors of texts: each letter has a random +-1 vector; a trigram binds its letters' vectors, permuted by
    two, one and no places, by multiplication; a text bundles its trigrams by addition.

    Letters count in lower case; each run of other characters is one space, as is the start of a text.
    """

    def __init__(self, dimensions: int, seed: int):
        self.d, self.seed = dimensions, seed
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.rows: dict[int, int] = {}
        self.vectors = np.zeros((0, dimensions), np.int8)

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code point in ``vectors``, which grows when a letter is new."""
        values, back = np.unique(codes, return_inverse=True)
        new = [int(c) for c in values if int(c) not in self.rows]
        if new:
            more = [np.random.Generator(np.random.Philox(key=[self.seed, c])).integers(0, 2, self.d, np.int8) * 2 - 1 for c in new]
            for c in new:
                self.rows[c] = len(self.rows)
            self.vectors = np.vstack([self.vectors, *more]).astype(np.int8)
        return np.array([self.rows[int(c)] for c in values])[back]

    def trigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, index into distinct) of every trigram, and the distinct trigrams as packed code points."""
        low = [" " + t.lower() + " " for t in texts]
        lens = np.fromiter(map(len, low), np.int64, len(low))
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[np.cumsum(lens) - lens] = True
        text = np.repeat(np.arange(len(low)), lens)[keep]
        c = np.where(letter, codes, SPACE)[keep].astype(np.int64)
        inside = text[2:] == text[:-2]
        keys = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[inside]
        distinct, index = np.unique(keys, return_inverse=True)
        return text[2:][inside], index, distinct

    def bound(self, distinct: np.ndarray) -> np.ndarray:
        a, b, c = (self._letters(distinct >> s & 0x1FFFFF) for s in (42, 21, 0))
        v = self.vectors
        return np.roll(v, 2, 1)[a] * np.roll(v, 1, 1)[b] * v[c]

    def bundle(self, groups: np.ndarray, index: np.ndarray, distinct: np.ndarray, n: int) -> np.ndarray:
        """Sum of trigram vectors by group, over slices of the trigrams so that memory stays small."""
        out = np.zeros((n, self.d), np.float32)
        order = np.argsort(index, kind="stable")
        groups, index = groups[order], index[order]
        for k in range(0, len(distinct), 4096):
            i, j = np.searchsorted(index, (k, k + 4096))
            width = min(4096, len(distinct) - k)
            counts = np.bincount(groups[i:j] * width + index[i:j] - k, minlength=n * width).reshape(n, width).astype(np.float32)
            out += counts @ self.bound(distinct[k : k + width]).astype(np.float32)
        return out


_READY: dict[tuple[int, int], Profiles] = {}


def profiles(dimensions: int, seed: int) -> Profiles:
    """One per Python worker."""
    if (dimensions, seed) not in _READY:
        _READY[dimensions, seed] = Profiles(dimensions, seed)
    return _READY[dimensions, seed]


def _pieces(batch: pa.RecordBatch, chars: int = 1 << 18, most: int = 128) -> Iterator[list[list]]:
    """Columns of a batch in runs of some 128 rows and 262,144 characters, which bounds a worker's memory."""
    rows, size = [[] for _ in batch.columns], 0
    for k in range(0, batch.num_rows, 64):
        for values in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns), strict=True):
            for r, v in zip(rows, values, strict=True):
                r.append(v)
            size += len(values[-1] or "")
            if size >= chars or len(rows[0]) >= most:
                yield rows
                rows, size = [[] for _ in batch.columns], 0
    if rows[0]:
        yield rows


def held_out(id_col: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit_languages(df: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = 1024, seed: int = 5, max_languages: int = 2000) -> dict[str, list[float]]:
    """Prototype of each language: the bundle of all its texts, from every row with a language.

    Tasks bundle their own rows and send one vector per language; the sums of whole numbers are exact in any order.
    The driver gets one vector per language; more than ``max_languages`` is an error. Rows without language or text are not used.
    """
    ship_package(df.sparkSession)

    def parts(batches):
        p, sums = profiles(dimensions, seed), {}
        for batch in batches:
            for langs, texts in _pieces(batch):
                names = sorted(set(langs))
                text, index, distinct = p.trigrams(texts)
                group = np.array([names.index(x) for x in langs])[text]
                for name, v in zip(names, p.bundle(group, index, distinct, len(names)), strict=True):
                    sums[name] = sums.get(name, 0.0) + v.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    rows = df.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("lang is not null and text is not null")
    sums = rows.mapInArrow(parts, "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    out: dict[str, list[float]] = {}
    for r in sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v")).limit(max_languages + 1).collect():
        out[r["lang"]] = r["v"]
    if len(out) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    return out


def predict_language(df: DataFrame, prototypes: dict[str, list[float]], id_col: str = "doc_id", text_col: str = "text", dimensions: int = 1024, seed: int = 5) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``: the prototype of highest cosine and that cosine (0 if negative).

    A map without shuffle over whole texts. ``und`` with score 0 where text is null or has no letter, or nothing was learned. Ties go to
    the first language by name. Only the text is an input; ``lang_pred`` and ``score`` of the input are replaced.
    """
    ship_package(df.sparkSession)
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in names], np.float64).reshape(len(names), dimensions)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = (matrix / np.where(lengths > 0, lengths, 1)).astype(np.float32)

    def scored(texts):
        if not names:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        p = profiles(dimensions, seed)
        text, index, distinct = p.trigrams(texts)
        v = p.bundle(text, index, distinct, len(texts))
        n = np.linalg.norm(v, axis=1, keepdims=True)
        cosines = (v @ unit.T) / np.where(n > 0, n, 1)
        best = cosines.argmax(1)
        some = np.bincount(text, minlength=len(texts)) > 0
        top = np.clip(cosines[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        return [names[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)], np.where(some, top, 0.0).tolist()

    keep = [c for c in df.columns if c.lower() not in ("lang_pred", "score")]
    at = keep.index(text_col)

    def predicted(batches):
        for batch in batches:
            langs, scores = [], []
            for (texts,) in _pieces(batch.select([batch.schema.names[at]])):
                a, b = scored([t or "" for t in texts])
                langs += a
                scores += b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    rows = df.select(*[f"`{c}`" for c in keep])
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(predicted, schema)
