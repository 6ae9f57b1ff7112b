"""Token-id files: canonical length-limited Huffman codes in independent blocks with bit-offset checkpoints.

Writing: texts are tokenized once and the ids kept in a shared table; ids are counted over all documents;
the code lengths (at most ``LIMIT`` bits, or as many as that number of ids needs, by package-merge) come from these global counts, and the codes
follow from the lengths alone. Rows are range-partitioned and sorted by doc_id and written as blocks of
``BLOCK`` ids. A block holds its bits, the bit offset of every ``STRIDE``-th id, and the parts of
documents in it, so any block, and any stride of it, can be decoded alone.

Reading: strides are decoded side by side with one table that maps the next ``LIMIT`` bits to an id and a
length. The driver handles one count for each id of the vocabulary and one sum for each file partition.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelica.llm.common import scratch_dir, written

LIMIT, BLOCK, STRIDE = 16, 65_536, 256
IDS_PER_PARTITION = 6_000_000
#: Texts of a worker whose ids are remembered, at most.
MEMORY = 1_200_000
#: Marks that may follow a word; the tokenizer starts a new word at the first of them.
MARKS = ".,;:!?&#*$%)"
#: White space other than space and line feed, for Unicode's or the library's idea of it.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff\u180e]")


def odd_space(text: str) -> bool:
    """Whether white space is more than single spaces and line feeds between other characters."""
    doubled = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
    return doubled or text[0] in " \n" or text[-1] in " \n" or _ODD.search(text) is not None


class Pieces(dict):
    """Ids of the pieces of texts, encoded by the library when first asked for.

    A piece has a space before it; one whose first character is a line feed begins a line and has none.
    Letters followed by marks are two words to the tokenizer, so they are remembered apart.
    """

    def __init__(self, encode, feed: bytes):
        super().__init__()
        self.ids, self.feed, self.marks = encode, feed, {}

    def __missing__(self, piece: str) -> bytes:
        if piece[0] == "\n":
            ids = self.feed + (self.ids(piece[1:]) if len(piece) > 1 else b"")
        else:
            word = piece.rstrip(MARKS)
            if word is not piece and len(word) < len(piece) and word.isalpha():
                tail = piece[len(word) :]
                if tail not in self.marks:
                    self.marks[tail] = self.ids(tail)
                ids = self[word] + self.marks[tail]
            else:
                ids = self.ids(" " + piece)
        self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Byte-level BPE never merges over the start of a word with the space before it, nor over a line feed
    between two other characters, so the pieces between them are encoded independently, and each distinct
    piece goes through the library once while it is remembered. Texts with other white space or a special
    token's name, and all texts of other kinds of tokenizers, go through whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.uint16 if self.tokenizer.get_vocab_size() <= 65_536 else np.uint32
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split["add_prefix_space"]
        self.piecewise = bool(plain and made["normalizer"] is None and made["model"]["type"] == "BPE")
        # For words of letters alone, which are one word to the tokenizer with the space before them: it need not search them.
        self.lines = Tokenizer.from_file(path)
        if self.piecewise:
            cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), cut])
        self.feed = self.library("\n")
        self.known = Pieces(self.library, self.feed)

    def letters(self, text: str) -> bytes:
        """The same as ``library`` for lines of one space and letters each."""
        return np.array(self.lines.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.width).tobytes()

    def library(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype=self.width).tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Encode the words of new pieces, those in a line and those that begin one, 2000 to a call."""
        words, others, leading, marked = set(), set(), set(), []
        for p in set(pieces):
            if p.isalpha():
                words.add(p)
            elif p[0] != "\n":
                w = p.rstrip(MARKS)
                if w.isalpha():
                    words.add(w)
                    marked.append((p, w))
                else:
                    others.add(p)
            elif len(p) > 1:
                leading.add(p)
        self.known.update(self.cut(list(words.difference(self.known)), " ", "\n ", letters=True))
        self.known.update(self.cut(list(others.difference(self.known)), " ", "\n "))
        known, marks = self.known, self.known.marks
        for p, w in marked:
            tail = p[len(w) :]
            if tail not in marks:
                marks[tail] = self.library(tail)
            known[p] = known[w] + marks[tail]
        firsts = list(leading)
        self.known.update((p, self.feed + ids) for p, ids in self.cut(firsts, "", "", skip=1))

    def cut(self, words: list[str], before: str, between: str, skip: int = 0, letters: bool = False) -> list[tuple[str, bytes]]:
        """The words with their ids: they are encoded in a row, each behind a line feed (that is the word's own first
        character where ``skip`` is 1), and the ids are cut at these. Words that cannot be told apart so are left out."""
        feed, size, out = np.frombuffer(self.feed, dtype=self.width), np.dtype(self.width).itemsize, []
        for at in range(0, len(words) if len(feed) == 1 else 0, 2000):
            part = words[at : at + 2000]
            raw = (self.letters if letters else self.library)((before + between.join(part))[skip:])
            cuts = np.flatnonzero(np.frombuffer(raw, dtype=self.width) == feed[0])
            if len(cuts) == len(part) - 1:  # else the pieces are encoded one by one when asked for
                starts, ends = [0, *(size * (cuts + 1)).tolist()], [*(size * cuts).tolist(), len(raw)]
                out += zip(part, [raw[x:y] for x, y in zip(starts, ends, strict=True)], strict=True)
        return out

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        # Nothing here makes cycles, and every collection would walk through all the remembered pieces.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts, end)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None], end: int) -> list[bytes]:
        tail, skip = np.array([end], dtype=self.width).tobytes(), len(self.feed)
        if len(self.known) > MEMORY:
            self.known = Pieces(self.library, self.feed)
        out: list[bytes] = [tail] * len(texts)
        known, open_, new = self.known, [], []
        for k, t in enumerate(texts):
            if not t:
                continue
            if not self.piecewise or odd_space(t) or any(s in t for s in self.special):
                out[k] = self.library(t) + tail
                continue
            pieces = ("\n" + t).replace("\n", " \n").split(" ")[1:]
            ids = list(map(known.get, pieces))
            if None in ids:
                missing = [i for i, x in enumerate(ids) if x is None]
                names = [pieces[i] for i in missing]
                new += names
                open_.append((k, ids, missing, names))
            else:
                out[k] = b"".join(ids)[skip:] + tail
        self.learn(new)
        for k, ids, missing, names in open_:
            for i, p in zip(missing, names, strict=True):
                ids[i] = known[p]
            out[k] = b"".join(ids)[skip:] + tail
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenize(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, ids (little-endian numbers of 16 bits, or 32 for a larger vocabulary), is_count.

    A task's last row has ``is_count``: its ids are the counts of all ids the task has made, in 64 bits.
    """
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        own = encoder(path)
        total = np.zeros(own.tokenizer.get_vocab_size(), dtype=np.int64)
        number = None
        for b in batches:
            number = b.column("doc_id").type
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids = own.encode(part.column("text").to_pylist(), end)
                total += np.bincount(np.frombuffer(b"".join(ids), dtype=own.width), minlength=len(total))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([False] * len(ids))], ["doc_id", "ids", "is_count"]
                )
        if number is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, number), pa.array([total.tobytes()]), pa.array([True])], ["doc_id", "ids", "is_count"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, is_count boolean")


def id_counts(tokens: DataFrame) -> DataFrame:
    """id, n: the tasks' counts added up."""

    def run(batches):
        for b in batches:
            for raw in b.column("ids").to_pylist():
                n = np.frombuffer(raw, dtype=np.int64)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["id", "n"])

    return tokens.where("is_count").select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; one symbol alone gets 1 bit."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    if n <= 1:
        return np.ones(n, dtype=np.uint8)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    # Level by level: pair the packages of the level below, merge the pairs with the leaves by weight.
    merged, levels = leaves, []
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        merged = both[rank]
    lengths, take = np.zeros(n, dtype=np.uint8), 2 * (n - 1)
    for is_leaf in reversed(levels):
        used = int(is_leaf[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    lengths[:take] += 1
    out = np.empty(n, dtype=np.uint8)
    out[order] = lengths
    return out


class Code:
    """Canonical codes: by length, then by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        limit = max(LIMIT, int(lengths.max())) if len(lengths) else LIMIT
        self.ids, self.lengths, self.limit = ids, lengths, limit
        order = np.lexsort((ids, lengths))
        slots = 1 << (limit - lengths[order].astype(np.int64))
        first = np.concatenate([[0], np.cumsum(slots)[:-1]]) if len(order) else np.zeros(0, np.int64)
        top = int(ids.max()) + 1 if len(ids) else 1
        self.code, self.length = np.zeros(top, dtype=np.uint64), np.zeros(top, dtype=np.int64)
        self.code[ids[order]] = (first >> (limit - lengths[order].astype(np.int64))).astype(np.uint64)
        self.length[ids[order]] = lengths[order]
        self.table = np.zeros(1 << limit, dtype=np.uint32)  # id in the upper bits, length in the lowest five
        if len(order):
            filled = np.repeat((ids[order].astype(np.uint32) << np.uint32(5)) | lengths[order].astype(np.uint32), slots)
            self.table[: len(filled)] = filled

    def pack(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The bits of some ids, and the bit offsets of every stride as 32-bit numbers."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        at = ends - lengths
        size = (int(ends[-1]) + 7) // 8 + 4 if len(ids) else 4
        spread = self.code[ids] << (np.uint64(32) - lengths.astype(np.uint64) - (at & 7).astype(np.uint64))
        out = np.zeros(size, dtype=np.int64)
        for k in range(4):
            byte = (spread >> np.uint64(24 - 8 * k)) & np.uint64(255)
            out += np.bincount((at >> 3) + k, weights=byte, minlength=size)[:size].astype(np.int64)
        return out.astype(np.uint8).tobytes(), at[::STRIDE].astype("<u4").tobytes()

    def unpack(self, payloads: list[bytes], offsets: list[bytes], sizes: list[int]) -> list[np.ndarray]:
        """The ids of some blocks; all their strides are decoded side by side."""
        base, lanes, lane_sizes = 0, [], []
        for p, o, n in zip(payloads, offsets, sizes, strict=True):
            own = np.frombuffer(o, dtype="<u4").astype(np.int64) + 8 * base
            lanes.append(own)
            lane_sizes.append(np.minimum(STRIDE, n - STRIDE * np.arange(len(own))))
            base += len(p)
        raw = np.frombuffer(b"".join(payloads) + bytes(8), dtype=np.uint8).astype(np.uint32)
        words = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
        at, left = np.concatenate(lanes), np.concatenate(lane_sizes)
        last = 8 * len(words) - 8
        out = np.empty((len(at), STRIDE), dtype=np.uint32)
        down = np.uint32(32 - self.limit)
        for k in range(STRIDE):
            word = words[at >> 3] << (at & 7).astype(np.uint32)
            entry = self.table[word >> down]
            out[:, k] = entry >> np.uint32(5)
            at = np.minimum(at + (entry & np.uint32(31)), last)
        flat = out[np.arange(STRIDE) < left[:, None]]
        return np.split(flat, np.cumsum(sizes)[:-1]) if sizes else []


BLOCK_SCHEMA = (
    "part int, first bigint, n_ids int, payload binary, offsets binary, "
    "piece_doc array<{kind}>, piece_start array<bigint>, piece_at array<bigint>, piece_n array<int>"
)


def write_blocks(tokens: DataFrame, code: Code, width: type, path: str, total: int) -> None:
    """Blocks in ascending doc_id order; ``first`` and ``piece_start`` count ids from the partition's start.

    Equal ids are ordered by their tokens' hash, so a much repeated id may span partitions.
    """
    kind = dict(tokens.dtypes)["doc_id"]
    shared = tokens.sparkSession.sparkContext.broadcast((code.ids, code.lengths))

    def run(batches):
        own = Code(*shared.value)
        part = TaskContext.get().partitionId()
        held, pieces, n, first = [], [], 0, 0

        def flush():
            ids = np.concatenate(held)
            payload, offsets = own.pack(ids)
            docs, starts, ats, sizes = ([p[k] for p in pieces] for k in range(4))
            return {"part": [part], "first": [first], "n_ids": [len(ids)], "payload": [payload], "offsets": [offsets],
                    "piece_doc": [docs], "piece_start": [starts], "piece_at": [ats], "piece_n": [sizes]}

        for b in batches:
            number = b.column("doc_id").type
            schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("payload", pa.binary()), ("offsets", pa.binary()), ("piece_doc", pa.list_(number)), ("piece_start", pa.list_(pa.int64())), ("piece_at", pa.list_(pa.int64())), ("piece_n", pa.list_(pa.int32()))])
            for doc, raw in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                ids = np.frombuffer(raw.as_buffer(), dtype=width)
                start, at = first + n, 0
                while at < len(ids):
                    take = min(BLOCK - n, len(ids) - at)
                    held.append(ids[at : at + take])
                    pieces.append((doc, start, at, take))
                    at, n = at + take, n + take
                    if n == BLOCK:
                        yield pa.RecordBatch.from_pydict(flush(), schema=schema)
                        held, pieces, n, first = [], [], 0, first + BLOCK
        if n:
            yield pa.RecordBatch.from_pydict(flush(), schema=schema)

    parts = max(1, -(-total // IDS_PER_PARTITION))
    order = ["doc_id", F.xxhash64("ids")]
    blocks = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    blocks.mapInArrow(run, BLOCK_SCHEMA.format(kind=kind)).write.option("compression", "none").parquet(f"{path}/blocks")


def encode(docs: DataFrame, tokenizer: str, path: str, end: int = 2) -> None:
    """Write the files of ``docs`` under ``path``: blocks and codebook.

    A null or empty text is one end id. Null ids come first; repeated ids and rows stay. An empty table
    gives files without blocks. Other columns are not read.
    """
    width = encoder(tokenizer).width
    tokens = written(tokenize(docs, tokenizer, end), "zstd")
    counts = id_counts(tokens).orderBy("id").collect()  # one row per vocabulary entry at most
    ids, n = np.array([r.id for r in counts], dtype=np.int64), np.array([r.n for r in counts], dtype=np.int64)
    code = Code(ids, code_lengths(n, max(LIMIT, len(n).bit_length())))
    spark = docs.sparkSession
    rows = [(int(i), int(c), int(k)) for i, c, k in zip(ids, n, code.lengths, strict=True)]
    spark.createDataFrame(rows, "id bigint, n bigint, length int").coalesce(1).write.parquet(f"{path}/codebook")
    write_blocks(tokens.where("not is_count").select("doc_id", "ids"), code, width, path, int(n.sum()))


def _square(m: list[int]) -> list[int]:
    return [_times(m, v) for v in m]


def _times(m: list[int], v: int) -> int:
    out, k = 0, 0
    while v:
        if v & 1:
            out ^= m[k]
        v >>= 1
        k += 1
    return out


def crc_join(a: int, b: int, n: int) -> int:
    """CRC-32 of two byte strings in a row from their own; n is the second's length in bytes."""
    step = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
    for _ in range(3):
        step = _square(step)
    while n:
        if n & 1:
            a = _times(step, a)
        step = _square(step)
        n >>= 1
    return a ^ b


def decode(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under ``path``.

    Blocks are decoded alone and in any order; a document in several blocks is put together from the
    checksums of its parts.
    """
    book = spark.read.parquet(f"{path}/codebook").collect()
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["piece_doc"].dataType.elementType.simpleString()
    shared = spark.sparkContext.broadcast(
        (np.array([r.id for r in book], dtype=np.int64), np.array([r.length for r in book], dtype=np.uint8))
    )

    def run(batches):
        own = Code(*shared.value)
        for b in batches:
            doc_type = b.column("piece_doc").type.value_type
            for at in range(0, b.num_rows, 16):
                p = b.slice(at, 16).to_pydict()
                found: dict[str, list] = {k: [] for k in ("part", "doc_id", "piece_start", "at", "n", "crc")}
                for k, ids in enumerate(own.unpack(p["payload"], p["offsets"], p["n_ids"])):
                    raw, x = memoryview(ids.astype("<u4").tobytes()), 0
                    for doc, start, within, n in zip(*(p[c][k] for c in ("piece_doc", "piece_start", "piece_at", "piece_n")), strict=True):
                        crc = zlib.crc32(raw[4 * x : 4 * (x + n)])
                        for name, v in zip(found, (p["part"][k], doc, start, within, n, crc), strict=True):
                            found[name].append(v)
                        x += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["part"], pa.int32()), pa.array(found["doc_id"], doc_type), *(pa.array(found[c], pa.int64()) for c in ("piece_start", "at", "n", "crc"))],
                    list(found),
                )

    pieces = blocks.drop("first").mapInArrow(run, f"part int, doc_id {kind}, piece_start bigint, at bigint, n bigint, crc bigint")
    docs = pieces.groupBy("part", "piece_start", "doc_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces"), F.sum("n").alias("n_tokens")
    )

    def join(batches):
        for b in batches:
            crcs = []
            for pieces_ in b.column("pieces").to_pylist():
                crc = pieces_[0]["crc"]
                for x in pieces_[1:]:
                    crc = crc_join(crc, x["crc"], 4 * x["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part", "piece_start", "doc_id", "n_tokens")), pa.array(crcs, pa.int64())], ["part", "piece_start", "doc_id", "n_tokens", "ids_crc32"])

    docs = docs.select("part", "piece_start", "doc_id", "n_tokens", "pieces").mapInArrow(join, f"part int, piece_start bigint, doc_id {kind}, n_tokens bigint, ids_crc32 bigint")
    # One row per file partition.
    before = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    return docs.join(before, "part").select("doc_id", (F.col("before") + F.col("piece_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write ``docs`` to the shared folder, and what reading the files back gives for each document."""
    path = scratch_dir(docs.sparkSession)
    encode(docs, tokenizer, path, end)
    return decode(docs.sparkSession, path)
