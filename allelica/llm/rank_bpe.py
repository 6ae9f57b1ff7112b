"""Byte-level BPE by a rank file: texts to token ids with the tiktoken library, and ids back to raw bytes.

The rank file is read through Spark's driver once and broadcast (a vocabulary, whose size does not grow with the
texts). Ids are a binary column of little-endian unsigned 32-bit integers, so counts, hashes and slices of them stay
SQL expressions.

A long text is cut before it is encoded, at places where a match of the split pattern ends whatever stands around it:

* before white space after another character: no match holds a character and white space after it, and white space
  looks only ahead;
* between closing marks and a letter of the listed ranges: a run of marks ends before a letter, and the contractions
  begin with an apostrophe, which is not among the marks.

A run of white space of ``RUN`` characters and more is a match by itself, less its last character where another
character follows; the library's own matcher overflows on very long ones. So memory and time of a text are those of
its pieces, and the ids are those of the whole text.

Null and empty texts have no ids; null and repeated document ids are rows like others; bytes that are not UTF-8 are
replaced by U+FFFD as the library does; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the split pattern of the public vocabularies, for which the cuts above hold.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: Unicode's white space, which is the pattern's \s.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[.,;:!?)\\]}}\u3002\uff01\uff1f\uff0c\u3001])(?=[A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff])")
#: Characters of a piece, about, and of white space that is a piece of its own.
PIECE, RUN = 50_000, 10_000


def cuts(text: str, piece: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``piece`` characters, cut at safe places; longer where there are none."""
    at = 0
    while len(text) - at > piece:
        last = None
        for last in CUT.finditer(text, at + piece // 2, at + piece):
            pass
        if last is None:
            last = CUT.search(text, at + piece)
        if last is None:
            break
        yield text[at : last.start()]
        at = last.start()
    yield text[at:]


def pieces(text: str, piece: int = PIECE, run: int = RUN) -> Iterator[tuple[str, bool]]:
    """(piece, whether it is one match) of a text, in order."""
    at = 0
    for m in re.finditer(f"[{WHITE}]{{{run},}}", text):
        if m.start() > at:
            yield from ((x, False) for x in cuts(text[at : m.start()], piece))
        at = m.end() if m.end() == len(text) else m.end() - 1
        yield text[m.start() : at], True
    if at < len(text):
        yield from ((x, False) for x in cuts(text[at:], piece))


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encode_text(encoding, text: str, safe: bool, piece: int = PIECE, run: int = RUN) -> bytes:
    """The ids of a whole text; with ``safe`` it may be cut."""
    if not safe or len(text) <= min(piece, run):
        return np.array(encoding.encode_ordinary(text), dtype="<u4").tobytes()
    parts = (encoding._encode_single_piece(x) if one else encoding.encode_ordinary(x) for x, one in pieces(text, piece, run))
    return b"".join(np.array(ids, dtype="<u4").tobytes() for ids in parts)


def decode_ids(encoding, ids: bytes, step: int = 1_000_000) -> bytes:
    every = np.frombuffer(ids, dtype="<u4")
    return b"".join(encoding.decode_bytes(every[k : k + step].tolist()) for k in range(0, len(every), step))


class Codec:
    """Column functions of one rank file and split pattern.

    >>> codec = Codec(spark, path, pattern)
    >>> docs.withColumn("ids", codec.encode("text")).withColumn("bytes", codec.decode("ids"))
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str = SPLIT):
        with open(path, "rb") as f:
            ranks = spark.sparkContext.broadcast(f.read())
        safe = pattern == SPLIT

        @F.arrow_udf("binary")
        def encode(texts: pa.Array) -> pa.Array:
            own = _encoding(ranks.value, pattern)
            return pa.array([encode_text(own, t.as_py().decode("utf-8", "replace"), safe) for t in texts], pa.binary())

        @F.arrow_udf("binary")
        def decode(ids: pa.Array) -> pa.Array:
            own = _encoding(ranks.value, pattern)
            return pa.array([decode_ids(own, x.as_py()) for x in ids], pa.binary())

        self._encode, self._decode = encode, decode

    def encode(self, text: str) -> Column:
        """The ids of a text column, none for a null."""
        return self._encode(F.coalesce(F.col(text), F.lit("")).cast("binary"))

    def decode(self, ids: str) -> Column:
        """The raw bytes of an ids column, none for a null; they need not be UTF-8 where ids were cut."""
        return self._decode(F.coalesce(F.col(ids), F.lit(b"")))


def count(ids: str) -> Column:
    """The number of ids in a binary column of them."""
    return F.floor(F.octet_length(ids) / 4).cast("bigint")


def round_trip(docs: DataFrame, path: str, pattern: str = SPLIT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: its ids, and the bytes decoded from them."""
    codec = Codec(docs.sparkSession, path, pattern)
    rows = docs.select("doc_id", codec.encode("text").alias("ids")).withColumn("raw", codec.decode("ids"))
    return rows.select("doc_id", count("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))
