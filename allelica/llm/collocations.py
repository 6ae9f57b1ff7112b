"""Frequent phrases and their collocation scores, mined by pivot partitioning as in MG-FSM.

1. Words are counted by language; those below ``least`` can stand in no frequent phrase and become gaps. The others are
   numbered, by language and falling frequency, so a larger number is a rarer word.
2. A phrase belongs to its pivot, its rarest word, and to that word's first place in it. Around every word of a text
   the fragment of words that its phrases can use is cut out: to the left words less rare than it, to the right none
   rarer, up to the next gap or the end of the piece. Equal fragments of a part of the input are one row with a number.
3. Fragments are dealt out by pivot, those of very frequent words by a salt too. A task counts the phrases of a group
   that hold the pivot, and no others, so no phrase is counted under two pivots; what a whole group has less than
   ``least`` times goes at once. Counts of salted or cut groups are added up after.
4. Scores and the removal of phrases inside longer ones are joins of the frequent phrases among themselves.

The numbers of the ``HEAD`` most frequent words are broadcast (a bound of its own, whatever the input); texts' rarer
frequent words get theirs by a join, in which no key is hot. Arithmetic of scores is of decimals of 38 digits.

Null and empty texts hold no words; a null language is ``und``; repeated rows count again; document ids play no part;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelica.llm.common import written

#: A-Z to a-z, marks and line ends to a line feed, which cuts pieces; tab to space.
TURNED = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
#: Words of a phrase, at most.
LONGEST = 5
#: Words whose numbers are broadcast, and the bytes of such a word.
HEAD, HEAD_BYTES = 300_000, 120
#: Words that a task turns to fragments at once, fragments that it mines at once, distinct words that it counts at once.
CHUNK, GROUP, COUNTED = 400_000, 1_000_000, 300_000
#: A word of more than this share of all words, and of this many, is salted; so there are few of them.
SALT_SHARE, SALT_ROWS = 2e-4, 200_000


def parts_of(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text")).where("text is not null")


def word_counts(parts: DataFrame) -> DataFrame:
    """lang, word, f; the word of a language's total is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def out():
            rows = [(lang, w, n) for lang, own in counts.items() for w, n in (*own.items(), (None, own.total()))]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)], ["lang", "word", "f"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                counts[lang].update(text.as_py().translate(TURNED).split())
                if len(counts[lang]) > COUNTED:
                    yield out()
        if any(counts.values()):
            yield out()

    return parts.mapInArrow(run, "lang string, word binary, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(counts: DataFrame, least: int) -> DataFrame:
    """id, lang, word, f of the frequent words, numbered by language and falling frequency without gaps."""
    spark = counts.sparkSession
    use = counts.where(F.col("word").isNotNull() & (F.col("f") >= least))
    order = ["lang", F.desc("f"), "word"]
    rows = written(use.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    # A row for each partition of the sorted words.
    slot = F.shiftright("at", 33)
    sizes = sorted(rows.groupBy(slot.alias("slot")).count().collect())
    before = np.cumsum([0, *[r["count"] for r in sizes]])[: len(sizes)].tolist()
    starts = spark.createDataFrame([(r.slot, n) for r, n in zip(sizes, before, strict=True)], "slot bigint, start bigint")
    number = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return written(rows.join(F.broadcast(starts), slot == F.col("slot")).select(number.cast("int").alias("id"), "lang", "word", "f"))


def fragments(ids: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fragments, numbers of them) of a row of word ids in which -1 is a gap, a chunk of pivots at a time: distinct
    rows of 2 * LONGEST - 1 ids, the pivot in the middle, -1 where the fragment has ended; those of one word are left
    out."""
    side = LONGEST - 1
    gap = np.full(side, -1, ids.dtype)
    wide = np.concatenate([gap, ids, gap])
    places = np.flatnonzero(ids >= 0)
    for first in range(0, len(places), chunk):
        at = places[first : first + chunk]
        own = ids[at]
        out = np.full((len(at), 2 * side + 1), -1, dtype=np.int32)
        out[:, side] = own
        for step, fits in ((-1, np.less), (1, np.less_equal)):
            alive = np.ones(len(at), dtype=bool)
            for k in range(1, side + 1):
                x = wide[at + side + step * k]
                alive &= (x >= 0) & fits(x, own)
                out[alive, side + step * k] = x[alive]
        out = out[(out[:, side - 1] >= 0) | (out[:, side + 1] >= 0)]
        if len(out):
            yield distinct(out, np.ones(len(out), dtype=np.int64))


def mixed(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row."""
    key = np.zeros(len(rows), dtype=np.uint64)
    for c in range(rows.shape[1]):
        key = (key ^ rows[:, c].astype(np.uint32)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def distinct(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the sums of their numbers, exactly: rows are sorted by a hash, and by themselves where
    two different ones meet in it."""
    if not len(rows):
        return rows, n
    key = mixed(rows)
    order = np.argsort(key, kind="stable")
    key, held = key[order], rows[order]
    same = (held[1:] == held[:-1]).all(axis=1)
    if (same != (key[1:] == key[:-1])).any():
        order = np.lexsort(rows.T)
        held = rows[order]
        same = (held[1:] == held[:-1]).all(axis=1)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    return held[first], np.add.reduceat(n[order], first)


def packed(rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """pivot, ids of each fragment: 32-bit integers, first eight times its number plus the words left of the pivot,
    then the words without the gaps."""
    side = LONGEST - 1
    held = np.concatenate([np.ones((len(rows), 1), dtype=bool), rows >= 0], axis=1)
    head = n * 8 + held[:, 1 : side + 1].sum(axis=1)
    ends = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32) * 4
    data = np.ascontiguousarray(np.concatenate([head[:, None], rows], axis=1)[held].astype("<i4"))
    ids = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(rows[:, side]), ids], ["pivot", "ids"])


def unpacked(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows and numbers that ``packed`` had."""
    side = LONGEST - 1
    ends = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) // 4
    data = np.frombuffer(ids.buffers()[2], dtype="<i4", count=int(ends[-1] - ends[0]), offset=4 * int(ends[0]))
    first = ends[:-1] - ends[0]
    n, left, sizes = data[first] >> 3, data[first] & 7, np.diff(ends) - 1
    out = np.full((len(ids), 2 * side + 1), -1, dtype=np.int32)
    at = np.arange(2 * side + 1)
    start = (side - left)[:, None]
    words = np.ones(len(data), dtype=bool)
    words[first] = False
    out[(at >= start) & (at < start + sizes[:, None])] = data[words]
    return out, n.astype(np.int64)


def phrases(rows: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases of one length, their numbers), all that hold the pivot, the fragments' middle."""
    side = LONGEST - 1
    for length in range(2, LONGEST + 1):
        found, sums = [], []
        for start in range(max(0, side + 1 - length), side + 1):
            window = rows[:, start : start + length]
            whole = (window[:, 0] >= 0) & (window[:, -1] >= 0)
            if whole.any():
                one, k = distinct(window[whole], n[whole])
                found.append(one)
                sums.append(k)
        if found:
            yield distinct(np.concatenate(found), np.concatenate(sums))


def fragment_rows(parts: DataFrame, words: DataFrame, head: int = HEAD) -> DataFrame:
    """pivot, ids of all the texts' fragments, as ``packed``; equal ones of a chunk are one row."""
    spark = parts.sparkSession
    short = words.where(F.octet_length("word") <= HEAD_BYTES)
    rows = short.orderBy(F.desc("f"), "id").limit(head).select("lang", "word", "id").toArrow()
    table: dict[str, dict[bytes, int]] = defaultdict(dict)
    for lang, word, number in zip(rows["lang"].to_pylist(), rows["word"].to_pylist(), rows["id"].to_pylist(), strict=True):
        table[lang][word] = number
    sent = spark.sparkContext.broadcast(dict(table))
    schema = "pivot int, ids binary"

    if words.count() == rows.num_rows:

        def run(batches):
            ids: list[int] = []
            for b in batches:
                for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                    get = sent.value.get(lang, {}).get
                    for piece in text.as_py().translate(TURNED).split(b"\n"):
                        ids.extend([get(w, -1) for w in piece.split()])
                        ids.append(-1)
                        if len(ids) > CHUNK:
                            yield from (packed(*x) for x in fragments(np.array(ids, dtype=np.int32)))
                            ids = []
            yield from (packed(*x) for x in fragments(np.array(ids, dtype=np.int32)))

        return parts.mapInArrow(run, schema)

    # Words beyond the head: a text keeps its ids and the places of the words it does not know; these are joined.
    def known(batches):
        for b in batches:
            out: dict[str, list] = {"part": [], "lang": [], "ids": [], "unknown": []}
            for part, lang, text in zip(b.column("part").to_pylist(), b.column("lang").to_pylist(), b.column("text"), strict=True):
                own, strange, ids = sent.value.get(lang, {}), {}, []
                for piece in text.as_py().translate(TURNED).split(b"\n"):
                    ids.extend([own[w] if w in own else -2 - strange.setdefault(w, len(strange)) for w in piece.split()])
                    ids.append(-1)
                for c, x in zip(out, (part, lang, np.array(ids, dtype="<i4").tobytes(), list(strange)), strict=True):
                    out[c].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int64()), pa.array(out["lang"], pa.string()), pa.array(out["ids"], pa.binary()), pa.array(out["unknown"], pa.list_(pa.binary()))], list(out))

    held = written(written(parts.withColumn("part", F.monotonically_increasing_id())).mapInArrow(known, "part bigint, lang string, ids binary, unknown array<binary>"))
    strange = held.select("part", "lang", F.posexplode("unknown").alias("k", "word"))
    named = strange.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("part").agg(F.collect_list(F.struct("k", "id")).alias("named"))

    def run(batches):
        for b in batches:
            for ids, pairs, size in zip(b.column("ids"), b.column("named").to_pylist(), b.column("size").to_pylist(), strict=True):
                number = np.full(size + 2, -1, dtype=np.int32)  # by -2 - k, and -1 for a gap
                for p in pairs or ():
                    number[p["k"] + 2] = p["id"]
                every = np.frombuffer(ids.as_py(), dtype="<i4")
                every = np.where(every >= 0, every, number[np.maximum(-every, 0)])
                yield from (packed(*x) for x in fragments(every.astype(np.int32)))

    return held.join(named, "part", "left").select("ids", "named", F.size("unknown").alias("size")).mapInArrow(run, schema)


def mined(rows: DataFrame, salts: DataFrame, least: int, group: int = GROUP) -> DataFrame:
    """phrase (ids), a: phrases with their numbers, of which none that has ``least`` is missing."""
    # A key is pivot and salt; those of salted words are odd.
    salt = F.when(F.col("salts").isNull(), 0).otherwise(1 + 2 * F.pmod(F.xxhash64("ids"), F.col("salts")))
    key = F.col("pivot").cast("bigint") * F.lit(1 << 22) + salt
    dealt = rows.join(F.broadcast(salts), "pivot", "left").select(key.alias("key"), "ids").repartition("key").sortWithinPartitions("key")

    def run(batches):
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held, last_cut = 0, None

        def flush(upto):
            """Mine all rows but those of the last group, or all of it."""
            nonlocal parts, held, last_cut
            key, x, n = (np.concatenate(c) for c in zip(*parts, strict=True))
            if upto == "groups":
                stop = int(np.searchsorted(key, key[-1]))
                stop = stop or len(key)  # one group alone is cut
            else:
                stop = len(key)
            own = key[:stop]
            # Groups that are salted (an odd key) or cut are not whole here: all their counts are passed on.
            partial = (own & 1) == 1
            if last_cut is not None:
                partial |= own == last_cut
            if stop == len(key) and upto == "groups":
                partial |= own == key[-1]
                last_cut = key[-1]
            whole = ~partial
            for on, most in ((whole, least), (partial, 1)):
                if on.any():
                    for found, a in phrases(x[:stop][on], n[:stop][on]):
                        keep = a >= most
                        if keep.any():
                            ids = found[keep]
                            ends = np.arange(0, ids.size + 1, ids.shape[1], dtype=np.int32)
                            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.ravel())), pa.array(a[keep])], ["phrase", "a"])
            parts = [(key[stop:], x[stop:], n[stop:])] if stop < len(key) else []
            held = len(key) - stop

        for b in batches:
            key = b.column("key").to_numpy()
            if len(key):
                parts.append((key, *unpacked(b.column("ids"))))
                held += len(key)
                if held >= group:
                    yield from flush("groups")
        if parts:
            yield from flush("all")

    found = dealt.mapInArrow(run, "phrase array<int>, a bigint")
    return found.groupBy("phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def spelled(found: DataFrame, words: DataFrame) -> DataFrame:
    """phrase (ids), a, lang, text, f: with the words and their own counts."""
    each = found.select("phrase", "a", F.posexplode("phrase").alias("k", "id")).join(words, "id")
    rows = each.groupBy("phrase", "a").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("k", "word", "f"))).alias("w"))
    text = F.array_join(F.transform("w", lambda x: x["word"].cast("string")), " ")
    return rows.select("phrase", "a", "lang", text.alias("text"), F.transform("w", lambda x: x["f"]).alias("f"))


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, text, phrase, a, l, r, n, score of the lowest-scoring cut of every phrase.

    A part of one word has the word's count, a longer one is itself among the phrases.
    """
    size = F.size("phrase")
    cut = found.select("phrase", "a", "lang", "text", "f", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    # Parts of one word need no join; their keys meet nothing and are spread.
    none = F.concat(F.array(F.lit(-1)), "phrase")
    left = F.when(F.col("k") > 1, F.slice("phrase", 1, F.col("k"))).otherwise(none)
    right = F.when(size - F.col("k") > 1, F.slice("phrase", F.col("k") + 1, size - F.col("k"))).otherwise(none)
    known = found.select(F.col("phrase").alias("part"), F.col("a").alias("count"))
    rows = cut.withColumns({"left": left, "right": right})
    rows = rows.join(known.withColumnsRenamed({"part": "left", "count": "l"}), "left", "left").join(known.withColumnsRenamed({"part": "right", "count": "r"}), "right", "left")
    rows = rows.withColumns({"l": F.coalesce("l", F.col("f")[0]), "r": F.coalesce("r", F.element_at("f", -1))}).join(totals, "lang")
    exact = lambda x: F.col(x).cast("decimal(38,0)")
    rows = rows.withColumns({"top": (exact("a") * exact("n")).cast("decimal(38,0)") * F.lit(1000).cast("decimal(38,0)"), "bot": exact("l") * exact("r")})
    rows = rows.withColumn("score", F.expr("top div bot"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    best = rows.groupBy("phrase").agg(lowest, *[F.first(c).alias(c) for c in ("lang", "text", "a", "n")])
    return best.select("lang", "text", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def outermost(rows: DataFrame, found: DataFrame, share: int = 100) -> DataFrame:
    """``rows`` without phrases that stand inside a longer one of ``found`` with 100 * its count >= share * theirs.

    Whatever holds a phrase and is two or more words longer holds one that is one word longer and no less frequent, so
    the phrases without their first or last word are all that is looked up.
    """
    size = F.size("phrase")
    inner = F.explode(F.array_distinct(F.array(F.slice("phrase", 1, size - 1), F.slice("phrase", 2, size - 1))))
    longer = found.where(size > 2).select(inner.alias("phrase"), "a").groupBy("phrase").agg(F.max("a").alias("outer"))
    return rows.join(longer, "phrase", "left").where(F.col("outer").isNull() | (100 * F.col("outer") < share * F.col("a"))).drop("outer")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, most: int = 2000, share: int = 100,
    head: int = HEAD, salt_rows: int = SALT_ROWS, salt_share: float = SALT_SHARE, group: int = GROUP,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``most`` phrases of 2 to 5 words by score."""
    parts = parts_of(docs, text, lang)
    counts = written(word_counts(parts))
    words = numbered(counts, least)
    totals = counts.where("word is null").select("lang", F.col("f").alias("n"))
    every = totals.agg(F.sum("n")).first()[0] or 0
    size = max(salt_rows, int(every * salt_share))
    # No more words than 1 / salt_share pass the limit.
    salts = words.where(F.col("f") > size).select(F.col("id").alias("pivot"), F.least(F.ceil(F.col("f") / size), F.lit(1 << 20)).cast("int").alias("salts"))
    found = written(spelled(mined(fragment_rows(parts, words, head), salts, least, group), words))
    out = outermost(scored(found, totals), found, share)
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text")
    ranked = out.withColumn("rank", F.row_number().over(first).cast("bigint")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
