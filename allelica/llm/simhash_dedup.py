"""Near duplicates by SimHash: fingerprints linked through a grid over segment bit counts.

Embedding: the 64 bits are cut into 16 segments of 4; the point of a fingerprint is its bit count per
segment, kept as 16 four-bit digits of one number. One differing bit moves one digit by one, so the
Manhattan distance of two points never exceeds the number of differing bits.

Grid range-join: each distinct fingerprint goes to the grid cell of its point and to the cells one step
away along each segment (33 at most). Two points at distance 2 or less always share a cell. Cells with
one fingerprint fall away; they are the great majority.

Exact check: in a shared cell, fingerprints are within 2 bits of each other exactly if some 64-bit word
of that cell differs from both by at most one bit. So each writes the words of that cell within one bit
of itself, and those that meet at a word are linked to the least of them: all links, a row for each
fingerprint and word, and never all pairs of a large group.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelica.llm.common import ROW, keyed, lower_words, own_names, passing, written
from allelica.llm.components import components

SEED, SHINGLE, SEGMENTS, BITS = 42, 3, 16, 2


def fingerprint(words: list[bytes], n: int = SHINGLE) -> int:
    """SimHash of the word shingles, repeats included; 0 without words."""
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < n else list(map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)))
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(raw), 65_536):
        ones += np.unpackbits(raw[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys and fp (the 64 bits as a signed long): one row per row; a null or empty text has 0."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            fps = np.array([fingerprint(lower_words(t)) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(b.column, keys), pa.array(fps)], [*keys, "fp"])

    rows = docs.select(*keys, F.col("text").cast("binary").alias("text"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", fp bigint")


def embed(fp: Column) -> Column:
    """Bit counts of the 16 four-bit segments, each in its own four bits."""
    m = lambda x: F.lit(x).cast("bigint")
    next_ = F.shiftrightunsigned(fp, 1)
    odd, two = m(0x5555555555555555), m(0x3333333333333333)
    pairs = fp.bitwiseXOR(next_).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(next_).bitwiseAND(odd), 1))
    return pairs.bitwiseAND(two) + F.shiftrightunsigned(pairs, 2).bitwiseAND(two)


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two fingerprints' points."""
    digit = lambda x, k: F.shiftrightunsigned(embed(x), 4 * k).bitwiseAND(F.lit(15))
    return reduce(lambda s, k: s + F.abs(digit(a, k) - digit(b, k)), range(SEGMENTS), F.lit(0))


def links(distinct_fp: DataFrame) -> DataFrame:
    """(a, b): every fingerprint linked to the least one that it meets; together they connect all pairs
    that differ in 2 bits or fewer. ``distinct_fp`` has one column fp without repeats."""
    steps = F.expr(
        "concat(array(struct(-1 as seg, 0 as up)), "
        f"transform(sequence(0, {SEGMENTS - 1}), i -> struct(i as seg, 1 as up)), "
        f"transform(sequence(0, {SEGMENTS - 1}), i -> struct(i as seg, 0 as up)))"
    )
    point = distinct_fp.select("fp", embed(F.col("fp")).alias("point"), F.explode(steps).alias("s")).select("fp", "point", "s.seg", "s.up")
    digit = F.expr("shiftrightunsigned(point, 4 * seg) & 15")
    inside = (F.col("seg") < 0) | ((F.col("up") == 1) & (digit < 4)) | ((F.col("up") == 0) & (digit > 0))
    unit = F.expr("shiftleft(1L, 4 * greatest(seg, 0))")
    cell = F.when(F.col("seg") < 0, F.col("point")).when(F.col("up") == 1, F.col("point") + unit).otherwise(F.col("point") - unit)
    # A row of the grid is two longs: the step follows from the cell and the fingerprint's own point. One
    # exchange brings each cell's rows together; the window counts them and spills where a cell is large.
    grid = point.where(inside).select("fp", cell.alias("cell"))
    near = grid.withColumn("n", F.count("*").over(Window.partitionBy("cell"))).where("n > 1").select("fp", "cell")
    moved = F.col("cell") - embed(F.col("fp"))
    # |moved| is 16 to the power of the segment.
    near = near.select(
        "fp", F.signum(moved.cast("double")).cast("int").alias("up"),
        F.when(moved == 0, 0).otherwise(F.length(F.conv(F.abs(moved), 10, 16)) - 1).alias("seg"),
    )
    words = near.select("fp", "up", "seg", F.explode(F.when(F.col("up") == 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(4))))).alias("k"))
    bit = F.expr("shiftleft(1L, 4 * seg + k)")
    # A step up sets a bit that is clear, a step down clears one that is set.
    fits = (F.col("up") == 0) | ((F.col("up") > 0) == (F.col("fp").bitwiseAND(bit) == 0))
    meet = written(words.where(fits).select("fp", F.when(F.col("up") == 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(bit)).alias("word")))
    least = meet.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("word", "b")
    pairs = meet.join(least, "word").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    # Lower bound, then the exact distance: every link is checked.
    return pairs.where(manhattan(F.col("a"), F.col("b")) <= BITS).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row per row of ``docs``.

    component_id is the least doc_id among all documents that can be reached over links of fingerprints
    differing in 2 bits or fewer. Null and empty texts have fingerprint 0 and are linked like others;
    null ids get rows but never name a component unless it has no other; repeated rows stay; an empty
    table gives an empty result; other columns are not read.
    """
    prints = written(fingerprints(docs))
    rooted, least = _leasts(prints, F.col("doc_id"))
    named = written(rooted.join(least, "root").select("fp", F.col("least").alias("component_id")))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def _leasts(prints: DataFrame, name: Column) -> tuple[DataFrame, DataFrame]:
    """(fp, root) of every fingerprint, and (root, least): the least ``name`` among the rows of a component."""
    reps = written(prints.groupBy("fp").agg(F.min(name).alias("rep")))
    comps = components(links(reps.select("fp")))
    rooted = reps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    return rooted.select("fp", "root"), rooted.groupBy("root").agg(F.min("rep").alias("least"))


@own_names(ROW)
def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the least doc_id; columns as before.

    Of several rows with that id the first stays, and a component without any id keeps its first row. Ids
    only order the rows: rows of other components are kept whatever ids they share. Null and empty texts are
    one component, an empty table stays empty, and further columns are passed on.
    """
    rows = keyed(docs)
    with passing(docs.sparkSession):
        prints = written(fingerprints(rows, ("doc_id", ROW)))
        _, least = _leasts(prints, F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", ROW))
        firsts = written(least.select(F.col(f"least.{ROW}").alias(ROW)), keep=True)
    # The same plan at every size: the rows kept grow with the documents, so neither side is broadcast.
    return rows.hint("merge").join(firsts, ROW, "left_semi").drop(ROW)
