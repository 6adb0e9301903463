"""Language-model scores by deleted interpolation of n-gram estimates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.plans.staging import stage, stage_path, unstage
from emberline.session import ship_package

END = "\n"  # No word holds white space.
BOS = -1
COUNTED, WEIGHED, HELD = 0, 1, 2  # n-grams counted; mixture weights learned; neither
SIDE = 64  # bit lengths of a count


def held_out(doc_id: Column) -> Column:
    """Texts that nothing is learned from: crc32 of the id as text, modulo 7, is 2. A null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def weighing(doc_id: Column) -> Column:
    """A tenth of the texts learned from: their n-grams are deleted from the counts while the weights are fitted."""
    return F.coalesce(F.crc32(F.concat(F.lit("weights "), doc_id.cast("string")).cast("binary")) % 10 == 0, F.lit(False))


def _mix(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of two 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(seed))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _tokenised(texts: pa.Array):
    """(words, counts): all words of the texts in one array, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, offsets = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    full = pc.not_equal(flat, "")
    upto = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return flat.filter(full), np.diff(upto[offsets])


def _pieces(batch: pa.RecordBatch, piece_bytes: int):
    """Slices of a batch with about so many bytes of text, one row at least."""
    size = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + piece_bytes)))
        yield batch.slice(at, end - at)
        at = end


class Block:
    """Some million tokens of neighbouring texts, and the distinct words, pairs and triples among them.

    A text is one segment, or several if it is longer than a block. A segment starts with two tokens of context: the
    words before it, or two start marks. ``codes`` are places in the sorted word hashes.
    """

    def __init__(self, hashes: np.ndarray, codes: np.ndarray, lens: np.ndarray, kinds: np.ndarray):
        self.hashes, self.codes, self.lens = hashes, codes, lens
        self.starts = np.cumsum(lens) - lens
        place = np.arange(len(codes)) - np.repeat(self.starts, lens)
        self.scored = place >= 2
        self.kind = np.where(self.scored, np.repeat(kinds, lens), HELD)
        self.marked = (place == 1) & (codes == BOS)
        self.paired = self.scored | ((place == 1) & (codes != BOS))

    def _counted(self, slots: np.ndarray, where: np.ndarray, n: int) -> list[np.ndarray]:
        return [np.bincount(slots[self.kind[where] == k], minlength=n) for k in (COUNTED, WEIGHED)]

    def words(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """(sorted keys, counts by kind) of the words."""
        return self.hashes, self._counted(self.codes[self.scored], self.scored, len(self.hashes))

    def grams(self, order: int, bits: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """(sorted keys of so many high bits, counts by kind, slot of each paired place, slot of each scored place) of pairs and, in order 3, triples."""
        h = np.append(self.hashes, np.uint64(0x51ED270B)).take(self.codes)  # code -1 is the last
        pairs = _mix(np.roll(h, 1), h, 2)
        triples = _mix(np.roll(pairs, 1), h, 3)[self.scored & (order == 3)]
        pairs, low = pairs[self.paired], np.uint64(64 - bits)
        keys, slots = np.unique(np.concatenate((pairs, triples)) >> low << low, return_inverse=True)
        two, three = slots[: len(pairs)], slots[len(pairs) :]
        counts = [a + b for a, b in zip(self._counted(two, self.paired, len(keys)), self._counted(three, self.scored & (order == 3), len(keys)), strict=True)]
        return keys, counts, two, three

    @classmethod
    def of(cls, batch: pa.RecordBatch, k: int) -> Block:
        raw = {name: batch.column(name)[k].as_py() for name in ("hashes", "codes", "lens", "kinds")}
        lens, kinds = (np.frombuffer(raw[c], "<i4") for c in ("lens", "kinds"))
        return cls(_ascending(raw["hashes"]), _inflated(raw["codes"], 4 * int(lens.sum()), "<i4"), lens, kinds)


def _planes(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences, bytes of one weight together, compressed, after eight bytes with their number."""
    return len(keys).to_bytes(8, "little") + _deflated(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _ascending(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.cumsum(_inflated(raw[8:], 8 * n, np.uint8).reshape(8, n).T.copy().view("<u8").ravel(), dtype=np.uint64)


def _small(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, bytes of one weight together, compressed, after a byte with the width."""
    most = int(counts.max()) if len(counts) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + _deflated(counts.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def _counts(raw: bytes, n: int) -> np.ndarray:
    return _inflated(raw[1:], n * raw[0], np.uint8).reshape(raw[0], n).T.copy().view(f"<u{raw[0]}").ravel().astype(np.int64)


def _deflated(raw: bytes) -> bytes:
    return pa.compress(raw, "zstd", asbytes=True)


def _inflated(raw: bytes, size: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, size, "zstd", asbytes=True), kind)


def _blocks(df: DataFrame, id_col: str, text_col: str, block_tokens: int) -> DataFrame:
    """One row per block: word hashes, codes, segments; ids and row numbers of the segments' texts; sums by kind of text."""
    kind_of_id = df.schema[id_col].dataType

    def cut(batches):
        part, number = TaskContext.get().partitionId(), 0
        parts, segments, size, block = [], [], 0, 0

        def flush():
            words = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            ids, rows, kinds, marks, counts, ends = zip(*segments, strict=True)
            marks, counts, ends = (np.array(x, np.int64) for x in (marks, counts, ends))
            lens = 2 * marks + counts + ends
            starts = np.cumsum(lens) - lens
            kinds = np.array(kinds)
            hashes, place = np.unique(np.array([xxhash.xxh3_64_intdigest(w) for w in (*coded.dictionary.to_pylist(), END)], np.uint64), return_inverse=True)
            out = np.full(lens.sum(), BOS, np.int32)
            out[np.repeat(starts + 2 * marks - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())] = place[codes]
            out[(starts + lens - 1)[ends == 1]] = place[-1]
            sums = [pa.array([int(x[kinds == k].sum())]) for x in (lens - 2, marks) for k in (COUNTED, WEIGHED, HELD)]
            arrays = [
                pa.array([part << 33 | block]),
                pa.array([rows], pa.list_(pa.int64())),
                pa.ListArray.from_arrays([0, len(ids)], pa.concat_arrays(ids)),
                *[pa.array([x]) for x in (kinds.astype("<i4").tobytes(), lens.astype("<i4").tobytes(), _deflated(out.tobytes()), _planes(hashes))],
                *sums,
            ]
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            for piece in _pieces(batch, 1 << 22):
                words, counts = _tokenised(piece.column(1))
                kinds, at = piece.column(2).to_pylist(), 0
                for k, n in enumerate(counts.tolist()):
                    done = 0  # tokens of this text, with the end
                    while done <= n:
                        take = min(n + 1 - done, max(block_tokens - size, 2))
                        first, last = max(done - 2, 0), min(done + take, n)
                        if last > first:
                            parts.append(words.slice(at + first, last - first))
                        segments.append((piece.column(0).slice(k, 1), part << 33 | number, kinds[k], int(not done), last - first, int(done + take > n)))
                        done, size = done + take, size + take
                        if size >= block_tokens:
                            yield flush()
                            parts, segments, size, block = [], [], 0, block + 1
                    at, number = at + n, number + 1
        if segments:
            yield flush()

    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("rows", T.ArrayType(T.LongType())),
            T.StructField("ids", T.ArrayType(kind_of_id)),
            *[T.StructField(c, T.BinaryType()) for c in ("kinds", "lens", "codes", "hashes")],
            *[T.StructField(f"{c}{k}", T.LongType()) for c in ("tokens", "texts") for k in (COUNTED, WEIGHED, HELD)],
        ]
    )
    ident = F.col(f"`{id_col}`")
    kind = F.when(held_out(ident), F.lit(HELD)).when(weighing(ident), F.lit(WEIGHED)).otherwise(F.lit(COUNTED))
    return df.select(ident.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), kind.alias("kind")).mapInArrow(cut, schema)


def _bucketed(blocks: DataFrame) -> DataFrame:
    """The blocks as a table bucketed by block, so that replies come to them and they are not shuffled again."""
    spark = blocks.sparkSession
    path = stage_path(spark, "lm-blocks")
    name = f"lm_blocks_{path[-32:]}"
    blocks.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.name, out.staged_at = name, path
    return out


def _requests(blocks: DataFrame, level: str, buckets: int, *how: int) -> DataFrame:
    """(level, bucket, block, keys, counted, weighed): what each block has of the words, or pairs and triples, whose hash starts with a bucket's bits."""

    def listed(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                keys, counts, *_ = getattr(Block.of(batch, k), level)(*how)
                cuts = _cuts(keys, buckets)
                full = np.flatnonzero(np.diff(cuts))
                slices = [(level, b, batch.column("block")[k].as_py(), _planes(keys[cuts[b] : cuts[b + 1]]), *[_small(c[cuts[b] : cuts[b + 1]]) for c in counts]) for b in full.tolist()]
                for at in range(0, len(slices), 64):
                    kinds = pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*slices[at : at + 64], strict=True), kinds, strict=True)], ["level", "bucket", "block", "keys", "counted", "weighed"])

    return blocks.select("block", "kinds", "lens", "codes", "hashes").mapInArrow(listed, "level string, bucket long, block long, keys binary, counted binary, weighed binary")


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the keys of each of a power of two of buckets start, and the end."""
    if buckets == 1:
        return np.array([0, len(keys)])
    first = np.arange(buckets, dtype=np.uint64) << np.uint64(65 - buckets.bit_length())
    return np.append(np.searchsorted(keys, first), len(keys))


def _replies(requests: DataFrame) -> DataFrame:
    """Per block and bucket which of its keys other blocks have too (``shared``, bits) and their counts over all blocks; a block
    knows the rest itself. A row of null block counts the bucket's keys that texts learned from, or texts counted, have."""

    def added(table: pa.Table) -> pa.Table:
        rows = table.select(["block", "keys", "counted", "weighed"]).to_pylist()
        keys = [_ascending(r["keys"]) for r in rows]
        sizes = [len(k) for k in keys]
        order = np.argsort(np.concatenate(keys), kind="stable")
        ranked = np.concatenate(keys)[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        at = np.flatnonzero(new)
        totals = [np.add.reduceat(np.concatenate([_counts(r[c], m) for r, m in zip(rows, sizes, strict=True)])[order], at) for c in ("counted", "weighed")]
        slot = np.empty(len(order), np.int64)
        slot[order] = np.cumsum(new) - 1
        common = np.diff(np.append(at, len(order))) > 1
        out, start = [], 0
        for r, n in zip(rows, sizes, strict=True):
            own = slot[start : start + n]
            start += n
            shared = common[own]
            if shared.any():
                out.append((r["block"], np.packbits(shared).tobytes(), *[_small(t[own[shared]]) for t in totals], 0, 0))
        out.append((None, None, None, None, int((sum(totals) > 0).sum()), int((totals[0] > 0).sum())))
        kinds = pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()
        columns = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.table([pa.array([table.column(c)[0].as_py()] * len(out), t) for c, t in (("level", pa.string()), ("bucket", pa.int64()))] + columns, ["level", "bucket", "block", "shared", "counted", "weighed", "learned", "main"])

    return requests.groupBy("level", "bucket").applyInArrow(added, "level string, bucket long, block long, shared binary, counted binary, weighed binary, learned long, main long")


def _shares(batch: pa.RecordBatch, k: int, letter: str, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimates after two words, after one, alone; bucket; starts) of the scored places of segments; the bucket is the bit lengths of both contexts' counts."""
    lens = np.frombuffer(batch.column("lens" if letter == "c" else "fitted")[k].as_py(), "<i4").astype(np.int64)
    one, two, three = (_counts(batch.column(f"{letter}{j}")[k].as_py(), int(lens.sum())) for j in (1, 2, 3))
    at = np.flatnonzero(np.arange(len(one)) - np.repeat(np.cumsum(lens) - lens, lens) >= 2)
    wide, narrow = two[at - 1], one[at - 1]
    shares = [np.where(d > 0, c[at] / np.maximum(d, 1), 0.0) for c, d in ((three, wide), (two, narrow))]
    shares.append(one[at] / tokens if tokens else np.ones(len(at)))  # without tokens, as the uniform estimate over none
    return np.stack(shares), np.frexp(wide.astype(np.float64))[1] * SIDE + np.frexp(narrow.astype(np.float64))[1], np.cumsum(lens - 2) - (lens - 2)


def _resolved(blocks: DataFrame, replies: DataFrame, n: dict[str, int], buckets: int, *how: int) -> DataFrame:
    """Blocks with their places' counts over all texts learned from, segment sums, and shares for fitting the weights."""
    seg = "rows array<long>, n_tokens array<long>, n_known array<long>, base array<double>"
    counts = ", ".join(f"{c}{k} binary" for c in "cm" for k in (1, 2, 3))
    schema = T._parse_datatype_string(f"block long, {seg}, lens binary, kinds binary, fitted binary, {counts}")
    schema.add("ids", blocks.schema["ids"].dataType)

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = left.combine_chunks().to_batches()[0]
        b = Block.of(batch, 0)
        grams = b.grams(*how)
        found = {"words": b.words(), "grams": grams[:2]}
        cuts = {level: _cuts(keys, buckets) for level, (keys, _) in found.items()}
        for r in right.to_pylist():
            low, high = cuts[r["level"]][r["bucket"] : r["bucket"] + 2]
            at = low + np.flatnonzero(np.unpackbits(np.frombuffer(r["shared"], np.uint8), count=high - low))
            for counts, name in zip(found[r["level"]][1], ("counted", "weighed"), strict=True):
                counts[at] = _counts(r[name], len(at))
        places = {}
        for name, (w, g) in {"all": [sum(found[level][1]) for level in ("words", "grams")], "main": [found[level][1][0] for level in ("words", "grams")]}.items():
            c1, c2, c3 = w[b.codes], *np.zeros((2, len(b.codes)), np.int64)
            c2[b.paired] = g[grams[2]]
            c3[b.scored & (how[0] == 3)] = g[grams[3]]
            # start marks: every text has them
            c1[b.codes == BOS] = c2[b.marked] = n["texts" if name == "all" else "main_texts"]
            places[name] = c1, c2, c3
        c1 = places["all"][0]
        known = np.where(b.scored, c1 > 0, 0)
        base = np.where(b.scored, np.log10((c1 + 1) / (n["tokens"] + n["words"] + 1)), 0.0)
        fit = b.kind == WEIGHED
        for k in (1, 2):  # with the places that the counts of their contexts stand at
            fit |= np.roll(b.kind == WEIGHED, -k)
        places["main"] = [c[fit] for c in places["main"]]
        fitted = np.add.reduceat(fit, b.starts)
        values = {
            "block": batch.column("block"),
            "rows": batch.column("rows"),
            **{name: pa.array([np.add.reduceat(x, b.starts)], pa.list_(kind)) for name, x, kind in (("n_tokens", b.scored.astype(np.int64), pa.int64()), ("n_known", known, pa.int64()), ("base", base, pa.float64()))},
            **{c: batch.column(c) for c in ("lens", "kinds")},
            "fitted": pa.array([fitted[fitted > 0].astype("<i4").tobytes()], pa.binary()),
            **{f"{letter}{k}": pa.array([_small(c)], pa.binary()) for letter, name in (("c", "all"), ("m", "main")) for k, c in enumerate(places[name], 1)},
            "ids": batch.column("ids"),
        }
        return pa.table([values[f.name] for f in schema.fields], schema.names)

    kept = blocks.select("block", "rows", "ids", "kinds", "lens", "codes", "hashes")
    return kept.groupBy("block").cogroup(replies.select("level", "bucket", "block", "shared", "counted", "weighed").groupBy("block")).applyInArrow(resolve, schema)


def starting_weights(order: int) -> np.ndarray:
    """(bucket, component): equal weights of triple, pair, word and uniform; none for a component whose context never occurs."""
    w = np.full((SIDE * SIDE, 4), 0.25)
    w[:SIDE, 0] = 0
    w[:, 0] *= order == 3
    w[::SIDE, 1] = 0
    return w / w.sum(1, keepdims=True)


def maximised(start: np.ndarray, bucket: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """New weights from expected counts by bucket. Each allowed component has one count more, so none becomes zero; a bucket
    without counts takes those of all buckets of its wider context, or else of all."""
    table = np.zeros_like(start)
    table[bucket] = expected
    wide = table.reshape(SIDE, SIDE, 4).sum(1).repeat(SIDE, 0)
    table = np.where(table.sum(1, keepdims=True) > 0, table, np.where(wide.sum(1, keepdims=True) > 0, wide, table.sum(0)))
    out = np.where(start > 0, table + 1, 0.0)
    return out / out.sum(1, keepdims=True)


def fit_weights(resolved: DataFrame, order: int, tokens: int, words: int, rounds: int, gain: float) -> np.ndarray:
    """Mixture weights by expectation-maximisation on the deleted texts; each round reads all their places and sends four sums a bucket.

    Ends after ``rounds``, or once the mean log10 probability of a token grows by less than ``gain``.
    """
    places = resolved.select("fitted", "m1", "m2", "m3").filter(F.octet_length("fitted") > 0)
    start = starting_weights(order)
    w, last = start, -np.inf
    for _ in range(rounds):

        def expected(batches, w=w):
            total = np.zeros((SIDE * SIDE, 5))
            for batch in batches:
                for k in range(batch.num_rows):
                    shares, bucket, _ = _shares(batch, k, "m", tokens)
                    p = np.concatenate((shares, np.full((1, len(bucket)), 1 / (words + 1)))) * w[bucket].T
                    sums = p.sum(0)
                    for j, x in enumerate((*p / sums, np.log10(sums))):
                        total[:, j] += np.bincount(bucket, x, SIDE * SIDE)
            at = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(total[at, j]) for j in range(5)]], ["bucket", "e3", "e2", "e1", "e0", "fit"])

        sums = places.mapInArrow(expected, "bucket int, e3 double, e2 double, e1 double, e0 double, fit double").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("e3", "e2", "e1", "e0", "fit")]).orderBy("bucket").toArrow()
        if not sums.num_rows:
            return w
        e = np.stack([sums.column(c).to_numpy() for c in ("e3", "e2", "e1", "e0")], 1)
        w = maximised(start, sums.column("bucket").to_numpy(), e)
        fit = sums.column("fit").to_numpy().sum() / e.sum()
        if fit - last < gain:
            break
        last = fit
    return w


def _scored(resolved: DataFrame, w: np.ndarray, n: dict[str, int]) -> DataFrame:
    """(row, id, kind, n_tokens, n_known, base, score) of every segment."""
    kind_of_id = resolved.schema["ids"].dataType.elementType

    def score(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                kinds = np.frombuffer(batch.column("kinds")[k].as_py(), "<i4")
                shares, bucket, starts = _shares(batch, k, "c", n["tokens"])
                p = np.log10((np.concatenate((shares, np.full((1, len(bucket)), 1 / (n["words"] + 1)))) * w[bucket].T).sum(0))
                lists = [batch.column(c).slice(k, 1).flatten() for c in ("rows", "ids", "n_tokens", "n_known", "base")]
                yield pa.RecordBatch.from_arrays([*lists[:2], pa.array(kinds), *lists[2:], pa.array(np.add.reduceat(p, starts))], ["row", "id", "kind", "n_tokens", "n_known", "base", "score"])

    schema = T._parse_datatype_string("row long, kind int, n_tokens long, n_known long, base double, score double")
    schema = T.StructType([schema["row"], T.StructField("id", kind_of_id), *schema.fields[1:]])
    return resolved.select("rows", "ids", "n_tokens", "n_known", "base", "lens", "kinds", "c1", "c2", "c3").mapInArrow(score, schema)


def interpolated_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, block_tokens: int = 1 << 20, rounds: int = 12, gain: float = 1e-4) -> DataFrame:
    """One row per text: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the whole text (runs without ASCII white space, A-Z in lower case) and one end. The model
    mixes maximum-likelihood estimates of a token after two words, after one, and alone, and a uniform one over the known
    words and one unknown. The four weights depend on how often the two words and the last word occur as contexts, by powers of two (``Block``, ``_shares``), and come
    from expectation-maximisation on a tenth of the texts learned from, under counts from the other nine tenths. Scores
    use the counts of all texts learned from. base_score is the sum of log10((c + 1) / (N + V + 1)).

    Texts are tokenised once and written in blocks of ``block_tokens``. Each block lists its distinct words, pairs and triples
    (pairs alone in ``order`` 2) as hashes with its own counts, sorted, and cut by the hashes' first bits into buckets of some half a million keys of
    all blocks, at most one entry a block and key, so a frequent word is no hot task. A bucket's counts are added up in one task and
    sent back for keys that two blocks or more have, since a block knows the counts of what it alone has. A longer text fills several
    blocks, each with the two words before it. Words have hashes of 64 bits, so two of n words share one with probability n ** 2 / 2 ** 65.
    Pairs and triples have 17 bits more than the number of tokens, so about one in 100,000 shares its count with another, at any size.

    Null or empty text is the end alone. A null id is learned from. Rows that repeat an id are scored, and counted, each; other columns are ignored. Without texts
    to learn from, every token has the probability of an unknown one. An empty table gives no rows.
    """
    ship_package(df.sparkSession)
    blocks = _bucketed(_blocks(df, id_col, text_col, block_tokens))
    sums = blocks.agg(*[F.sum(f"{c}{k}").alias(f"{c}{k}") for c in ("tokens", "texts") for k in (COUNTED, WEIGHED, HELD)]).collect()[0]
    n = {"main_tokens": sums["tokens0"] or 0, "main_texts": sums["texts0"] or 0}
    n |= {"tokens": n["main_tokens"] + (sums["tokens1"] or 0), "texts": n["main_texts"] + (sums["texts1"] or 0)}
    total = n["tokens"] + (sums["tokens2"] or 0)
    buckets, bits = 1 << (total >> 19).bit_length(), min(64, total.bit_length() + 17)
    words = stage(_replies(_requests(blocks, "words", buckets)), "lm-words")
    known = words.filter("block IS NULL").agg(F.sum("learned"), F.sum("main")).collect()[0]
    n |= {"words": known[0] or 0, "main_words": known[1] or 0}
    replies = words.unionByName(_replies(_requests(blocks, "grams", buckets, order, bits))).filter("block IS NOT NULL")
    resolved = stage(_resolved(blocks, replies, n, buckets, order, bits), "lm-resolved")
    df.sparkSession.sql(f"DROP TABLE {blocks.name}")
    unstage(blocks, words)
    w = fit_weights(resolved, order, n["main_tokens"], n["main_words"], rounds, gain)
    segments = _scored(resolved, w, n)
    out = segments.groupBy("row").agg(F.first("id").alias("id"), F.first("kind").alias("kind"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return out.select(F.col("id").alias(id_col), (F.col("kind") == HELD).alias("held_out"), "n_tokens", "n_known", F.lit(n["tokens"]).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
