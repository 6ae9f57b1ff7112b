"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

Trusted text is all text of labelled documents (quality 1, not toxic) but a fifth that is held out for the thresholds.
Its places (two words before and the word) and those of the documents meet in groups by the middle word: there lie
the counts of a trigram, of its context, of the bigram in it and of that one's context, so a group makes its part of
the model from its trusted places and scores the documents' places with it. A place is packed to a few bytes: frequent
trusted words are numbers by rank, other trusted words are hashes, and words that a filter of fixed size tells not to be
trusted ones are one sign, as the model knows nothing of them. What a filter lets through by mistake only
costs room. Discounts come from counts of counts that the groups add up; the lowest order, by the word alone, is sent
for frequent words and joined for others. Groups return sums by document.

``model`` and ``perplexities`` are the same model with its numbers sent to every task, for small trusted text.

Every document gets a perplexity. A language's threshold is a quantile of the perplexities of its trusted
documents that were held out of the training; documents above it are rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelica.llm.common import ROW, discard, keyed, scratch, words_of, written

#: Trusted places of a group, about; places that are packed together; documents of them at most.
GROUP, CHUNK, CHUNK_DOCS = 1_000_000, 1_000_000, 60_000
#: Trusted words that are numbers by rank; bits of the filter for the others.
COMMON, FILTER_BITS = 500_000, 27
#: Where a bounded sample is asked for, longer trusted texts are cut into passages of so many words.
PASSAGE = 20_000
QUANTILE = 0.97
START, END = np.uint64(1), np.uint64(2)
TRIGRAM, TRIGRAM_LEFT, BIGRAM, BIGRAM_LEFT, WORD = range(5)


def key2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)


class Hasher:
    """64-bit hashes of words, remembered up to a limit."""

    def __init__(self, limit: int = 500_000):
        self.limit, self.known = limit, {}

    def text(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w) | 4  # never START or END
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _ngrams(texts: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """u, v, w of every position of the texts (words and an end), and the number of positions of each."""
    parts, sizes = [], []
    for t in texts:
        h = hasher.text(t.split())
        parts += [np.array([START, START]), h, np.array([END])]
        sizes.append(len(h) + 1)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    sizes = np.array(sizes, dtype=np.int64)
    at = np.arange(sizes.sum()) + 2 * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    return flat[at - 2], flat[at - 1], flat[at], sizes


def trusted_sample(docs: DataFrame, labels: DataFrame, max_docs: int | None = None, max_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(training rows: doc_id, text; held-out rows: doc_id). A fifth of the trusted ids is held out by hash.

    All trusted text, unless bounds are given: then at most ``max_docs``, in hash order until ``max_words`` words, a
    long text in passages with places of their own in that order.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").where("doc_id is not null").distinct()
    digest = F.md5(F.concat(F.lit("trust:"), F.col("doc_id").cast("string")).cast("binary"))
    good = good.select("doc_id", digest.alias("digest"), (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held"))
    chosen = good.where("not held")
    if max_docs is not None:
        chosen = chosen.orderBy("digest", "doc_id").limit(max_docs)
    # A filter of fixed size lets all chosen ids through and few others; only ids are moved to find these.
    bits = docs.sparkSession.sparkContext.broadcast(word_filter(chosen.select(F.xxhash64("doc_id").alias("h")), np.zeros(0, np.uint64)))
    may = F.pandas_udf(lambda h: pd.Series(passes(bits.value, h.to_numpy().view(np.uint64))), "boolean")
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null").where(may(F.xxhash64("doc_id")))
    others = written(texts.select("doc_id").distinct().join(chosen, "doc_id", "left_anti"))
    texts = texts.join(others, "doc_id", "left_anti")
    if max_words is None:
        return texts, good.where("held").select("doc_id")
    texts = texts.join(chosen, "doc_id")
    size = min(PASSAGE, max_words)  # the first passage always fits
    words = words_of(F.col("text"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / size).cast("int")), lambda k: F.array_join(F.slice(words, k * size + 1, size), " "))
    parts = texts.select("doc_id", "digest", F.posexplode(F.when(F.size(words) > size, cut).otherwise(F.array("text"))).alias("part", "text"))
    place = F.when(F.col("part") == 0, F.col("digest")).otherwise(F.md5(F.concat_ws(":", "digest", "part").cast("binary")))
    parts = keyed(parts.select("doc_id", "text", place.alias("place"), F.size(words_of(F.col("text"))).alias("n")))
    # The running total sees no texts, only their places and lengths.
    order = Window.orderBy("place", "doc_id", "hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = parts.select(ROW, "place", "doc_id", F.xxhash64("text").alias("hash"), "n").withColumn("upto", F.sum("n").over(order)).where(F.col("upto") <= max_words)
    return written(parts.join(fits.select(ROW), ROW, "left_semi").select("doc_id", "text")), good.where("held").select("doc_id")


def _discounts(counts: DataFrame) -> list[float]:
    row = counts.agg(*[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    return _cuts(*(int(x or 0) for x in row))


def _cuts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]


def model(training: DataFrame) -> tuple[DataFrame, float, int]:
    """(kind, a, b, c, value) of the interpolated model; the weight of unseen words; the number of words.

    For a seen n-gram the value is its discounted share, for a context the weight left for the lower order.
    """

    def rows(batches):
        hasher = Hasher()
        for b in batches:
            u, v, w, _ = _ngrams([t for t in b.column("text").to_pylist()], hasher)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v, w)], ["u", "v", "w"])

    tri = written(training.select(F.col("text").cast("binary").alias("text")).mapInArrow(rows, "u bigint, v bigint, w bigint").groupBy("u", "v", "w").agg(F.count("*").alias("c")))
    bi = written(tri.groupBy("v", "w").agg(F.count("*").alias("c")))
    uni = written(bi.groupBy("w").agg(F.count("*").alias("c")))

    def order(counts: DataFrame, left: list[str], kinds: tuple[int, int]) -> list[DataFrame]:
        d = _discounts(counts)
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = counts.groupBy(*left).agg(F.sum("c").alias("total"), F.sum(cut).alias("cut"))
        share = counts.join(context.select(*left, "total"), left).withColumn("value", (F.col("c") - cut) / F.col("total"))
        pad = [F.lit(0).cast("bigint").alias(f"p{k}") for k in range(3)]
        names = ["a", "b", "c"]
        grams = share.select(F.lit(kinds[0]).alias("kind"), *[F.col(x).alias(n) for x, n in zip([*left, "w"], names, strict=False)], *[p.alias(n) for p, n in zip(pad, names[len(left) + 1 :], strict=False)], "value")
        contexts = context.select(F.lit(kinds[1]).alias("kind"), *[F.col(x).alias(n) for x, n in zip(left, names, strict=False)], *[p.alias(n) for p, n in zip(pad, names[len(left) :], strict=False)], (F.col("cut") / F.col("total")).alias("value"))
        return [grams, contexts]

    d = _discounts(uni)
    cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    sums = uni.agg(F.sum("c").alias("n"), F.sum(cut).alias("cut"), F.count("*").alias("v")).first()
    total, types = float(sums.n or 1), int(sums.v)
    left = float(sums["cut"] or 1.0) / total / (types + 1)  # what an unseen word gets, and each seen one more
    zero = F.lit(0).cast("bigint")
    words = uni.select(F.lit(WORD).alias("kind"), F.col("w").alias("a"), zero.alias("b"), zero.alias("c"), ((F.col("c") - cut) / F.lit(total) + F.lit(left)).alias("value"))
    parts = [*order(tri, ["u", "v"], (TRIGRAM, TRIGRAM_LEFT)), *order(bi, ["v"], (BIGRAM, BIGRAM_LEFT)), words]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return written(whole), left, types


class Shard:
    """One kind of the model's numbers in an open-addressed table, looked up many keys at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.values = np.zeros(1 << self.bits, dtype=np.float32)
        mask = (1 << self.bits) - 1
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = keys[free]  # of several keys for one slot the last stays
            won = free[self.keys[at[free]] == keys[free]]
            self.values[at[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        out = np.full(len(keys), default, dtype=np.float32)
        at, left, mask = self._slots(keys), np.arange(len(keys)), (1 << self.bits) - 1
        while len(left):
            held = self.keys[at]
            same = held == keys[left]
            out[left[same]] = self.values[at[same]]
            more = ~same & (held != 0)
            left, at = left[more], (at[more] + 1) & mask
        return out


def shards(grams: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and values of each kind. Tasks pack them, 12 bytes to a number; the driver only joins the pieces.

    The bound: a sample of n words has at most 5 (n + documents) numbers, whatever the corpus.
    """

    def pack(batches):
        held: dict[int, list] = {}
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            a, b, c = (batch.column(n).to_numpy().view(np.uint64) for n in "abc")
            values = batch.column("value").to_numpy().astype(np.float32)
            for kind in np.unique(kinds).tolist():
                at = kinds == kind
                x, y, z = a[at], b[at], c[at]
                keys = key2(key2(x, y), z) if kind == TRIGRAM else key2(x, y) if kind in (TRIGRAM_LEFT, BIGRAM) else x | np.uint64(1)
                held.setdefault(kind, []).append((keys, values[at]))
        for kind, parts in held.items():
            keys, values = (np.concatenate(p).tobytes() for p in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([keys], pa.binary()), pa.array([values], pa.binary())], ["kind", "keys", "values"])

    found: list[list] = [[] for _ in range(5)]
    for r in grams.mapInArrow(pack, "kind int, keys binary, values binary").toLocalIterator():
        found[r["kind"]].append((np.frombuffer(r["keys"], dtype=np.uint64), np.frombuffer(r["values"], dtype=np.float32)))
    none = [(np.zeros(0, np.uint64), np.zeros(0, np.float32))]
    return [tuple(np.concatenate(p) for p in zip(*(parts or none), strict=True)) for parts in found]


def log_probs(u: np.ndarray, v: np.ndarray, w: np.ndarray, tables: list[Shard], unseen: float) -> np.ndarray:
    p = tables[WORD].get(w | np.uint64(1), unseen)
    p = tables[BIGRAM].get(key2(v, w), 0.0) + tables[BIGRAM_LEFT].get(v | np.uint64(1), 1.0) * p
    uv = key2(u, v)
    p = tables[TRIGRAM].get(key2(uv, w), 0.0) + tables[TRIGRAM_LEFT].get(uv, 1.0) * p
    return np.log10(p.astype(np.float64))


def perplexities(docs: DataFrame, grams: DataFrame, unseen: float) -> DataFrame:
    """doc_id, lang, n_words, log10_prob, perplexity of every row; the end counts as a word."""
    shared = docs.sparkSession.sparkContext.broadcast(shards(grams))
    rows = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        tables, hasher = [Shard(k, v) for k, v in shared.value], Hasher()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                u, v, w, sizes = _ngrams(part.column("text").to_pylist(), hasher)
                logs = np.add.reduceat(log_probs(u, v, w, tables, unseen), np.cumsum(sizes) - sizes)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), pa.array(sizes - 1), pa.array(logs), pa.array(10.0 ** np.minimum(-logs / sizes, 300.0))],
                    ["doc_id", "lang", "n_words", "log10_prob", "perplexity"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, lang string, n_words bigint, log10_prob double, perplexity double")


# The model in groups.

UNKNOWN, FIRST = np.uint64(3), 4  # the sign of words that are not trusted, the number of the most frequent word
RARE = np.uint64(1 << 63)
ESCAPE = (1 << 24) - 1  # in the place of a hash


class Signs:
    """Words as numbers by rank, hashes or UNKNOWN."""

    def __init__(self, common: np.ndarray, bits: np.ndarray):
        self.order = np.argsort(common)
        self.sorted, self.bits, self.known = common[self.order], bits, {}

    def text(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        new = list(set(words).difference(known))
        h = np.fromiter((xxhash.xxh64_intdigest(w) | 4 for w in new), dtype=np.uint64, count=len(new))
        signs = np.where(passes(self.bits, h), h | RARE, UNKNOWN)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            signs = np.where(self.sorted[at] == h, self.order[at].astype(np.uint64) + np.uint64(FIRST), signs)
        known.update(zip(new, signs.tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def word_counts(training: DataFrame) -> DataFrame:
    """h (hash), n: words of the trusted text."""

    def run(batches):
        held: dict[bytes, int] = {}

        def out():
            words, n = list(held), list(held.values())
            h = np.fromiter((xxhash.xxh64_intdigest(w) | 4 for w in words), dtype=np.uint64, count=len(words))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

        for b in batches:
            for t in b.column("text").to_pylist():
                for w in t.split():
                    held[w] = held.get(w, 0) + 1
                if len(held) > 500_000:
                    yield out()
                    held.clear()
        yield out()

    return training.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def most_frequent(words: DataFrame, limit: int) -> np.ndarray:
    """Hashes of at most ``limit`` words (h, n), the most frequent first: all above a count, so no partition sends more."""
    left, least = limit, None
    for r in words.groupBy("n").count().orderBy(F.col("n").desc()).limit(limit).toLocalIterator():
        left -= r["count"]
        if left < 0:
            break
        least = r["n"]
    found = words.where(F.col("n") >= least if least is not None else F.lit(False)).toArrow()
    order = np.lexsort((found["h"].to_numpy(), -found["n"].to_numpy()))
    return found["h"].to_numpy()[order].view(np.uint64)


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter lets hashes through."""
    out = np.ones(len(h), dtype=bool)
    for k in (4, 20, 36):
        at = (h >> np.uint64(k)) & np.uint64(8 * len(bits) - 1)
        out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
    return out


def word_filter(words: DataFrame, common: np.ndarray) -> np.ndarray:
    """Bits of a filter of fixed size that lets all hashes h but the common ones through: tasks set theirs, pieces are joined."""
    some = words.sparkSession.sparkContext.broadcast(common)
    piece = 1 << 16

    def run(batches):
        bits = np.zeros(1 << FILTER_BITS - 3, dtype=np.uint8)
        top = np.sort(some.value)
        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64)
            if len(top):
                h = h[top[np.minimum(np.searchsorted(top, h), len(top) - 1)] != h]
            for k in (4, 20, 36):
                at = (h >> np.uint64(k)) & np.uint64((1 << FILTER_BITS) - 1)
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        for k in range(0, len(bits), piece):
            if bits[k : k + piece].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits[k : k + piece].tobytes()])], ["at", "bits"])

    out = np.zeros(1 << FILTER_BITS - 3, dtype=np.uint8)
    for r in words.coalesce(8).select("h").mapInArrow(run, "at int, bits binary").toLocalIterator():
        out[r["at"] : r["at"] + piece] |= np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _planes(x: np.ndarray, width: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _pack(u: np.ndarray, v: np.ndarray, w: np.ndarray, doc: np.ndarray | None) -> tuple[bytes, int]:
    """Places as bytes, and their size before compression. Documents are steps, as those of one middle word ascend."""
    columns = [u, v, w]
    parts = [np.array([len(u), *((x >= ESCAPE).sum() for x in columns)], dtype=np.int64).tobytes()]
    parts += [_planes(np.minimum(x, ESCAPE), 3) for x in columns]
    if doc is not None:
        parts.append(_planes(np.diff(doc, prepend=np.uint64(0)), 2))
    raw = b"".join([*parts, *(x[x >= ESCAPE].tobytes() for x in columns)])
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def _unpack(data: bytes, size: int, with_doc: bool) -> list[np.ndarray]:
    raw = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)
    n, *escaped = np.frombuffer(raw, dtype=np.int64, count=4).tolist()
    out, at = [], 32
    for width in (3, 3, 3, 2)[: 4 if with_doc else 3]:
        x = np.zeros((n, 8), dtype=np.uint8)
        x[:, :width] = np.frombuffer(raw, dtype=np.uint8, count=width * n, offset=at).reshape(width, n).T
        out.append(x.reshape(-1).view("<u8"))
        at += width * n
    if with_doc:
        out[3] = np.cumsum(out[3], dtype=np.uint64) & np.uint64(65_535)
    for x, k in zip(out, escaped, strict=False):
        x[x == ESCAPE] = np.frombuffer(raw, dtype=np.uint64, count=k, offset=at)
        at += 8 * k
    return out


def _places(rows: DataFrame, shared, groups: int, docs: bool) -> DataFrame:
    """g, chunk, size, data: packed places of the rows' texts by group; with ``docs`` also a row for each chunk with
    doc_id, lang and n_words of its documents."""
    kind = dict(rows.dtypes)["doc_id"] if docs else "bigint"

    def run(batches):
        signs = Signs(*shared.value)
        task, number = TaskContext.get().partitionId() << 24, 0

        def flush():
            u, v, w, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
            # Where the middle word is unknown no group knows more than another.
            lead = np.where(v == UNKNOWN, key2(w, doc), key2(v, v))
            g = ((lead >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(g * (1 << 24) + np.minimum(v, ESCAPE).astype(np.int64), kind="stable")
            g, u, v, w, doc = (x[order] for x in (g, u, v, w, doc))
            cuts = np.flatnonzero(np.diff(g, prepend=-1, append=groups))
            found = [_pack(u[a:b], v[a:b], w[a:b], doc[a:b] if docs else None) for a, b in zip(cuts, cuts[1:], strict=False)]
            n = len(found)
            columns = [pa.array(g[cuts[:-1]], pa.int32()), pa.array([task | number] * n, pa.int64()), pa.array([s for _, s in found], pa.int64()), pa.array([d for d, _ in found], pa.binary())]
            names = ["g", "chunk", "size", "data"]
            if not docs:
                return pa.RecordBatch.from_arrays(columns, names)
            ids, langs = (pa.concat_arrays(x) for x in (ids_, langs_))
            one = [pa.array([task | number], pa.int64()), pa.array([0], pa.int64()), pa.array([None], pa.binary())]
            columns = [pa.concat_arrays([x, y]) for x, y in zip(columns, [pa.array([task % groups], pa.int32()), *one], strict=True)]
            for values in (ids, langs, pa.array(sizes - 1, pa.int64())):
                columns.append(pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(values)], pa.int32()), values))
            return pa.RecordBatch.from_arrays(columns, [*names, "doc_id", "lang", "n_words"])

        held, ids_, langs_, n_places, n_docs = [], [], [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                held.append(_ngrams(part.column("text").to_pylist(), signs))
                if docs:
                    ids_.append(part.column("doc_id"))
                    langs_.append(part.column("lang"))
                n_places, n_docs = n_places + len(held[-1][0]), n_docs + part.num_rows
                if n_places >= CHUNK or n_docs + 500 > CHUNK_DOCS:
                    yield flush()
                    held, ids_, langs_, n_places, n_docs, number = [], [], [], 0, 0, number + 1
        if held:
            yield flush()

    schema = "g int, chunk bigint, size bigint, data binary" + (f", doc_id array<{kind}>, lang array<string>, n_words array<bigint>" if docs else "")
    return rows.mapInArrow(run, schema)


class Counts:
    """The counts of a group's trusted places, by order."""

    def __init__(self, places: list[list[np.ndarray]]):
        u, v, w = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in zip(*places, strict=True)) if places else (np.zeros(0, np.uint64),) * 3
        self.tri, at, self.c = np.unique(key2(key2(u, v), w), return_index=True, return_counts=True)
        self.uv, v, w = key2(u[at], v[at]), v[at], w[at]
        self.bi, at, self.n_before = np.unique(key2(v, w), return_index=True, return_counts=True)
        self.v, self.w = v[at], w[at]

    def shards(self, discounts: list[list[float]]) -> dict[int, Shard]:
        out = {}
        for d, keys, left, c, kinds in (
            (discounts[0], self.tri, self.uv, self.c, (TRIGRAM, TRIGRAM_LEFT)),
            (discounts[1], self.bi, self.v | np.uint64(1 << 62), self.n_before, (BIGRAM, BIGRAM_LEFT)),
        ):
            cut = np.array(d)[np.minimum(c, 3) - 1]
            context, of = np.unique(left, return_inverse=True)
            total = np.bincount(of, weights=c, minlength=len(context))
            out[kinds[0]] = Shard(keys, ((c - cut) / total[of]).astype(np.float32))
            out[kinds[1]] = Shard(context, (np.bincount(of, weights=cut, minlength=len(context)) / total).astype(np.float32))
        return out


def scores(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, log10_prob, perplexity of every row by the model of all training text (doc_id, text)."""
    spark = docs.sparkSession
    with scratch() as used:
        words = written(word_counts(training))
    total = int(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    common = most_frequent(words, COMMON)
    shared = spark.sparkContext.broadcast((common, word_filter(words, common)))
    discard(spark, used)
    groups = max(1, -(-total // GROUP), min(16, total // 100_000))
    trusted = _places(training.select(F.col("text").cast("binary").alias("text")), shared, groups, False)

    def count(batches):
        for places in _by_group(batches):
            own = Counts(places)
            for order, c in ((0, own.c), (1, own.n_before)):
                n = np.bincount(np.minimum(c, 5), minlength=5)[1:5]
                yield pa.RecordBatch.from_arrays([pa.array([order] * 4, pa.int32()), pa.array([1, 2, 3, 4], pa.int64()), pa.array(n, pa.int64())], ["kind", "w", "n"])
            w, n = np.unique(own.w, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([2] * len(w), pa.int32()), pa.array(w.view(np.int64)), pa.array(n, pa.int64())], ["kind", "w", "n"])

    sums = written(_sorted_groups(trusted, groups).mapInArrow(count, "kind int, w bigint, n bigint").groupBy("kind", "w").agg(F.sum("n").alias("n")))
    uni = sums.where("kind = 2").select("w", F.col("n").alias("c"))
    found = {(r.kind, r.w): int(r.n) for r in sums.where("kind < 2").collect()}
    discounts = [_cuts(*(found.get((order, k), 0) for k in (1, 2, 3, 4))) for order in (0, 1)]
    d = _discounts(uni)
    cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    whole = uni.agg(F.sum("c").alias("n"), F.sum(cut).alias("cut"), F.count("*").alias("v")).first()
    n, unseen = float(whole.n or 1), float(whole["cut"] or 1.0) / float(whole.n or 1) / (int(whole.v) + 1)
    values = uni.select("w", ((F.col("c") - cut) / F.lit(n) + F.lit(unseen)).alias("value"))
    low = np.full(FIRST + len(common), unseen)
    numbered = values.where(F.col("w").between(0, len(low))).toArrow()  # one row per common word at most
    low[numbered["w"].to_numpy()] = numbered["value"].to_numpy()
    table = spark.sparkContext.broadcast(low)
    rows = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    asked = _places(rows, shared, groups, True).withColumn("asks", F.lit(1))
    none = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in ("doc_id", "lang", "n_words")]
    both = asked.unionByName(trusted.select("g", "chunk", "size", "data", *none, F.lit(0).alias("asks")))
    schema = f"chunk bigint, doc_id array<{kind}>, lang array<string>, n_words array<bigint>, data binary, at int, w bigint, high double, low double"
    names = ["chunk", "doc_id", "lang", "n_words", "data", "at", "w", "high", "low"]

    def answer(batches):
        g, places, tables = None, [], None
        for b in batches:
            for k, (own, asks, size, data) in enumerate(zip(*(b.column(c).to_pylist() for c in ("g", "asks", "size", "data")), strict=True)):
                chunk = b.column("chunk").slice(k, 1)
                if own != g:
                    g, places, tables = own, [], None
                if not asks:
                    places.append(_unpack(data, size, False))
                    continue
                if data is None:  # the documents of a chunk
                    yield pa.RecordBatch.from_arrays([chunk, *(b.column(c).slice(k, 1) for c in ("doc_id", "lang", "n_words")), *_nulls(1)], names)
                    continue
                if tables is None:
                    tables, places = Counts(places).shards(discounts), []
                u, v, w, doc = _unpack(data, size, True)
                uv, doc = key2(u, v), doc.astype(np.int64)
                left = tables[TRIGRAM_LEFT].get(uv, 1.0).astype(np.float64)
                high = tables[TRIGRAM].get(key2(uv, w), 0.0) + left * tables[BIGRAM].get(key2(v, w), 0.0)
                left *= tables[BIGRAM_LEFT].get(v | np.uint64(1 << 62), 1.0)
                rare = w >= RARE
                logs = np.log10(high[~rare] + left[~rare] * table.value[w[~rare].astype(np.int64)])
                at, of = np.unique(doc[~rare], return_inverse=True)
                raw = at.astype("<u2").tobytes() + np.bincount(of, weights=logs, minlength=len(at)).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays([chunk, *_lists(1, number, text), pa.array([raw], pa.binary()), *_nulls(1)[1:]], names)
                m = int(rare.sum())
                if m:
                    yield pa.RecordBatch.from_arrays([pa.repeat(chunk[0], m), *_lists(m, number, text), pa.nulls(m, pa.binary()), pa.array(doc[rare], pa.int32()), pa.array(w[rare].view(np.int64)), pa.array(high[rare]), pa.array(left[rare])], names)

    from pyspark.sql.pandas.types import to_arrow_type

    number, text = to_arrow_type(rows.schema["doc_id"].dataType), pa.string()
    answers = written(both.repartition(groups, "g").sortWithinPartitions("g", "asks", "chunk").mapInArrow(answer, schema), "zstd")

    def finish(batches):
        chunk, lists, logs = None, None, None

        def out():
            ids, langs, n_words = lists
            k = len(ids)
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(chunk, pa.int64()), k), pa.array(np.arange(k), pa.int32()), ids, langs, n_words, pa.array(logs[:k])], ["chunk", "at", "doc_id", "lang", "n_words", "log"])

        for b in batches:
            for k, own in enumerate(b.column("chunk").to_pylist()):
                if own != chunk:
                    if chunk is not None:
                        yield out()
                    chunk, logs = own, np.zeros(1 << 16)
                data = b.column("data")[k].as_py()
                if data is None:
                    lists = [b.column(c)[k].values for c in ("doc_id", "lang", "n_words")]
                else:
                    n = len(data) // 6
                    logs[np.frombuffer(data, dtype="<u2", count=n)] += np.frombuffer(data, dtype=np.float32, offset=2 * n)
        if chunk is not None:
            yield out()

    per = answers.where("w is null").select("chunk", "doc_id", "lang", "n_words", "data", F.xxhash64("data").alias("h"))
    per = per.repartition("chunk").sortWithinPartitions("chunk", "h").drop("h").mapInArrow(finish, f"chunk bigint, at int, doc_id {kind}, lang string, n_words bigint, log double")
    rare = answers.where("w is not null").join(values, "w", "left")
    rare = rare.groupBy("chunk", "at").agg(F.sum(F.log10(F.col("high") + F.col("low") * F.coalesce("value", F.lit(unseen)))).alias("rare"))
    log = F.col("log") + F.coalesce("rare", F.lit(0.0))
    return per.join(rare, ["chunk", "at"], "left").select("doc_id", "lang", "n_words", log.alias("log10_prob"), F.pow(F.lit(10.0), F.least(-log / (F.col("n_words") + 1), F.lit(300.0))).alias("perplexity"))


def _lists(n: int, number: pa.DataType, text: pa.DataType) -> list[pa.Array]:
    return [pa.nulls(n, pa.list_(x)) for x in (number, text, pa.int64())]


def _nulls(n: int) -> list[pa.Array]:
    return [pa.nulls(n, x) for x in (pa.binary(), pa.int32(), pa.int64(), pa.float64(), pa.float64())]


def _sorted_groups(packed: DataFrame, groups: int) -> DataFrame:
    return packed.select("g", "chunk", "size", "data").repartition(groups, "g").sortWithinPartitions("g", "chunk")


def _by_group(batches):
    """The trusted places of each group."""
    g, places = None, []
    for b in batches:
        for own, size, data in zip(*(b.column(c).to_pylist() for c in ("g", "size", "data")), strict=True):
            if own != g:
                if places:
                    yield places
                g, places = own, []
            places.append(_unpack(data, size, False))
    if places:
        yield places


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, **bounds) -> DataFrame:
    """doc_id, lang, n_words, log10_prob, perplexity, threshold, kept: one row per row.

    The threshold is the quantile of the perplexities of the language's held-out trusted documents; a language
    without any takes that of all languages. Without trusted documents to train on, or to set a threshold,
    it is null and every row with words is kept. Empty and null texts have no words and are not kept; repeated
    rows score alike; an empty table gives an empty result; other columns are not read.
    """
    training, held = trusted_sample(docs, labels, **bounds)
    scored = written(scores(docs, training))
    trusted = scored.where("n_words > 0").join(held, "doc_id", "left_semi").where(F.lit(not training.isEmpty()))
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    per_lang = trusted.groupBy("lang").agg(at.alias("own"))
    overall = trusted.agg(at.alias("all")).first()["all"]
    s, t = scored.alias("s"), per_lang.alias("t")
    limit = F.coalesce("t.own", F.lit(overall).cast("double"))
    return s.join(t, F.col("s.lang").eqNullSafe(F.col("t.lang")), "left").select(
        "s.*", limit.alias("threshold"), ((F.col("s.n_words") > 0) & (limit.isNull() | (F.col("s.perplexity") <= limit))).alias("kept")
    )
