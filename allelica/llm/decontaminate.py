"""Benchmark decontamination with suffix arrays over the training documents.

Each task reads its documents in shards of a bounded number of words and builds the shard's suffix array
over word numbers; a word that no test item holds has number 0. A suffix with a 0 among its first words
cannot hold a window, so only the others are sorted, by as many words as a window has: no shorter match is
reported. The window at the head of every test suffix is binary-searched in every shard; its interval gives
all places. Each place is then looked up among the sorted test suffixes: its neighbours there hold the
longest verbatim match that begins at the place, whatever its length. The result for a document does not
depend on what else is in its shard.

The test set is sent to the tasks in blocks of at most ``block_bytes``, one pass over the documents for each
block; it is never sent unbounded. Nothing of the documents is shuffled but the hits when there are several
blocks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelica.llm.common import plain_words, written

WINDOW = 10
BLOCK_BYTES = 12_000_000
SHARD_WORDS = 1_000_000


class TestBlock:
    """Test items as numbers: the vocabulary, the sorted suffixes, and the windows with their items."""

    __test__ = False

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.names = sorted({n for n, _ in items})
        place = {n: k for k, n in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        suffixes: dict[bytes, int] = {}  # word numbers, four bytes each, most significant first -> least item
        windows: dict[bytes, set[int]] = {}
        for name, words in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            raw, own = np.array(numbers, dtype=">u4").tobytes(), place[name]
            size = min(window, len(numbers))
            for at in range(len(numbers) - size + 1 if numbers else 0):
                windows.setdefault(raw[4 * at : 4 * (at + size)], set()).add(own)
                suffix = raw[4 * at :]
                suffixes[suffix] = min(suffixes.get(suffix, own), own)
        self.suffixes = sorted(suffixes)
        self.owner = [suffixes[x] for x in self.suffixes]
        self.windows = [(w, sorted(items_)) for w, items_ in sorted(windows.items())]
        self.least = min((len(w) // 4 for w, _ in self.windows), default=0)
        self.window, self.longest = window, max((len(x) // 4 for x in self.suffixes), default=0)

    def match(self, key: bytes) -> tuple[int, int]:
        """Words of the longest common beginning of ``key`` with a test suffix, and the least item that has it."""
        at = bisect_left(self.suffixes, key)
        n = max((common_words(key, self.suffixes[k]) for k in (at - 1, at) if 0 <= k < len(self.suffixes)), default=0)
        lo = bisect_left(self.suffixes, key[: 4 * n])
        hi = bisect_left(self.suffixes, key[: 4 * n] + b"\xff" * 4)
        return n, min(self.owner[lo:hi], default=-1)


def common_words(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // 4
    differ = np.flatnonzero(np.frombuffer(a, dtype=np.uint32, count=n) != np.frombuffer(b, dtype=np.uint32, count=n))
    return int(differ[0]) if len(differ) else n


class Shard:
    """The suffix array of some documents' words, in the order of their first ``block.window`` words."""

    def __init__(self, docs: list[list[bytes]], block: TestBlock):
        number = block.vocabulary.get
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        flat = np.zeros(int(self.starts[-1]) + block.window, dtype=np.uint32)
        for d, s in zip(docs, self.starts[:-1], strict=True):
            flat[s : s + len(d)] = np.fromiter((number(w, 0) for w in d), dtype=np.uint32, count=len(d))
        self.raw = flat.astype(">u4").tobytes()
        known = flat != 0
        run = known.copy()
        for k in range(1, block.least):
            run[:-k] &= known[k:]
        raw, width = self.raw, 4 * block.window
        self.array = sorted(np.flatnonzero(run).tolist(), key=lambda p: raw[4 * p : 4 * p + width])

    def bound(self, prefix: bytes, above: bool, lo: int = 0) -> int:
        """Number of suffixes below the prefix; with above, also those that start with it."""
        n, raw, array, hi = len(prefix), self.raw, self.array, len(self.array)
        while lo < hi:
            mid = (lo + hi) // 2
            key = raw[4 * array[mid] : 4 * array[mid] + n]
            if key < prefix or (above and key == prefix):
                lo = mid + 1
            else:
                hi = mid
        return lo

    def places(self, prefix: bytes) -> list[int]:
        lo = self.bound(prefix, False)
        return self.array[lo : self.bound(prefix, True, lo)]


def search(docs: list[list[bytes]], block: TestBlock) -> list[dict]:
    """For each document that a window occurs in: ``doc`` (place in ``docs``), starts and ends of the hit
    spans, items (numbers), and longest, at, item: words and first word of the longest verbatim match that
    holds a window, the earliest of several, and the least item with it."""
    shard = Shard(docs, block)
    if not shard.array:
        return []
    flags = np.zeros(int(shard.starts[-1]) + 1, dtype=np.int32)
    items: dict[int, set[int]] = {}
    best: dict[int, tuple[int, int, int]] = {}  # document -> words, minus the place, minus the item
    starts = shard.starts
    for window, names in block.windows:
        found = shard.places(window)
        if not found:
            continue
        size = len(window) // 4
        at = np.array(found)
        np.add.at(flags, at, 1)
        np.add.at(flags, at + size, -1)
        for p, d in zip(found, (np.searchsorted(starts, at, side="right") - 1).tolist(), strict=True):
            items.setdefault(d, set()).update(names)
            n, own = size, names[0]
            if size == block.window:
                end = min(int(starts[d + 1]) - 1, p + block.longest)
                n, own = block.match(shard.raw[4 * p : 4 * end])
            best[d] = max(best.get(d, (0, 0, 0)), (n, -p, -own))
    hit = np.cumsum(flags) > 0
    out = []
    for d in sorted(items):
        own = hit[starts[d] : starts[d + 1]].astype(np.int8)
        edge = np.diff(np.concatenate([[0], own, [0]]))
        n, p, item = best[d]
        out.append({
            "doc": d, "starts": np.flatnonzero(edge == 1).tolist(), "ends": np.flatnonzero(edge == -1).tolist(),
            "items": sorted(items[d]), "longest": n, "at": int(-p - starts[d]), "item": -item,
        })
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[TestBlock]:
    """The test items in blocks of at most ``block_bytes`` of text; a longer item is a block of its own.

    The driver reads the items one partition after another and holds one block. Items without words have no
    window and are left out; a null id counts as ''.
    """
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    held, size = [], 0
    for r in items.toLocalIterator():
        raw = r.text.encode()
        if held and size + len(raw) > block_bytes:
            yield TestBlock(held)
            held, size = [], 0
        if words := plain_words(raw):
            held.append((r.item if r.item is not None else "", words))
            size += len(raw)
    if held:
        yield TestBlock(held)


MATCH = "starts array<int>, ends array<int>, items array<string>, longest bigint, longest_start bigint, longest_item string"


def matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row for every document: doc_id, copy (hash of the text), n_words, starts and ends of the hit spans,
    items (ids), longest, longest_start, longest_item. Without test items one pass still counts the words."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("copy"), F.col("text").cast("binary").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    types = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string())
    names = ["doc_id", "copy", "n_words", "starts", "ends", "items", "longest", "longest_start", "longest_item"]

    def passed(block) -> DataFrame:
        def run(batches):
            test = block.value

            def part(b, words):
                n = len(words)
                found = {f["doc"]: f for f in (search(words, test) if test.windows else ())}
                get = lambda k: found.get(k, {})
                cells = (
                    [get(k).get("starts", []) for k in range(n)], [get(k).get("ends", []) for k in range(n)],
                    [[test.names[i] for i in get(k).get("items", ())] for k in range(n)], [get(k).get("longest", 0) for k in range(n)],
                    [get(k).get("at") for k in range(n)], [test.names[found[k]["item"]] if k in found else None for k in range(n)],
                )
                counts = pa.array([len(w) for w in words], pa.int64())
                return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy"), counts, *(pa.array(c, t) for c, t in zip(cells, types, strict=True))], names)

            for b in batches:
                yield from (part(b.slice(at, len(words)), words) for at, words in _shards(b, shard_words))

        return rows.mapInArrow(run, f"doc_id {kind}, copy bigint, n_words bigint, {MATCH}")

    spark = docs.sparkSession
    found = [passed(spark.sparkContext.broadcast(b)) for b in _blocks(benchmark, block_bytes)]
    if len(found) < 2:
        return found[0] if found else passed(spark.sparkContext.broadcast(TestBlock([])))
    # Several blocks: one pass each, brought together by id and text; equal rows are counted, not lost.
    union = reduce(DataFrame.unionByName, [f.withColumn("part", F.lit(k)) for k, f in enumerate(found)])
    once = written(union).groupBy("doc_id", "copy", "n_words", "part").agg(
        *[F.first(c).alias(c) for c in ("starts", "ends", "items")],
        F.first(F.struct("longest", (-F.col("longest_start")).alias("place"), "longest_item")).alias("best"),
        F.count("*").cast("int").alias("rows"),
    )
    # Of matches of one length and place the least item counts, as within a block.
    best = F.array_sort("all", lambda x, y: F.when(x["longest"] != y["longest"], F.signum(y["longest"] - x["longest"])).when(
        ~x["place"].eqNullSafe(y["place"]), F.signum(F.coalesce(y["place"] - x["place"], F.lit(0)))).when(
        x["longest_item"] < y["longest_item"], -1).when(x["longest_item"] > y["longest_item"], 1).otherwise(0).cast("int"))[0]
    whole = once.groupBy("doc_id", "copy", "n_words").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.collect_list("best").alias("all"),
        F.max("rows").alias("rows"),
    ).withColumn("best", best)
    return whole.select(
        "doc_id", "copy", "n_words", "starts", "ends", "items", F.col("best.longest").alias("longest"),
        (-F.col("best.place")).alias("longest_start"), F.col("best.longest_item").alias("longest_item"),
        F.explode(F.sequence(F.lit(1), "rows")).alias("k"),
    ).drop("k")


def _shards(batch: pa.RecordBatch, shard_words: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of its rows) of the shards of a batch: rows until ``shard_words`` words are held."""
    held, words, at = [], 0, 0
    for k, t in enumerate(batch.column("text").to_pylist()):
        held.append(plain_words(t))
        words += len(held[-1]) + 1
        if words >= shard_words:
            yield at, held
            held, words, at = [], 0, k + 1
    if held:
        yield at, held


def merged_length(starts: str = "starts", ends: str = "ends"):
    """Words under spans that may overlap."""
    spans = F.array_sort(F.arrays_zip(F.col(starts).alias("s"), F.col(ends).alias("e")))
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("at")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["at"], x["s"]))).alias("n"), F.greatest(a["at"], x["e"]).alias("at")
        ),
        lambda a: a["n"],
    )


def report(docs: DataFrame, benchmark: DataFrame, **sizes) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_start, longest_item: words
    of the longest verbatim match that holds a window, its first word in the document and its item.

    One row per document row; a null or empty text has no words and is clean: longest 0, its place and item
    null. Of equally long matches the earliest counts, then the least item id as a string. Items without words
    match nothing, items with a null id count as ''. Repeated rows are counted each. Without any item all
    documents are clean; an empty table gives an empty result; other columns are not read.
    """
    rows = matches(docs, benchmark, **sizes)
    names = F.array_join(F.array_sort(F.array_distinct("items")), ",")
    n_hit = merged_length().cast("bigint")
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(F.array_distinct("items")).cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "longest", "longest_start", "longest_item",
    )


def remove(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents that hold no window of a test item; columns as before. Rows are filtered where they are
    read, block after block of the test set, so no text is shuffled.

    Null and empty texts stay, and so do all rows without any item; every row is judged by its own text, so
    repeated and null ids need no care; an empty table stays empty.
    """
    out = docs
    for test in _blocks(benchmark, block_bytes):
        out = _without(out, docs.sparkSession.sparkContext.broadcast(test), shard_words)
    return out


def _without(docs: DataFrame, block, shard_words: int) -> DataFrame:
    def run(batches):
        for b in batches:
            keep = np.ones(b.num_rows, dtype=bool)
            texts = pa.RecordBatch.from_arrays([b.column("text").cast(pa.binary())], ["text"])
            for at, words in _shards(texts, shard_words):
                keep[[at + f["doc"] for f in search(words, block.value)]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
