"""Column functions over alleles and chromosome names, and the ordered id hash."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Chromosome codes of the file formats.
X, Y, MT, XY, BAD = 23, 24, 90, 91, 99


def complement(allele: Column) -> Column:
    return F.translate(allele, "ACGT", "TGCA")


def match_code(ref1: Column, alt1: Column, ref2: Column, alt2: Column, strand_check: bool = True) -> Column:
    """1 same alleles, 2 swapped (calls must be flipped), 0 mismatch, -1 unknown, -2 ambiguous strand.

    Direct and swapped order come first, X stands for any allele, then the other strand is tried.
    """
    unknown = reduce(lambda a, b: a | b, [x.isin("N", "0") | x.isNull() for x in (ref1, alt1, ref2, alt2)])
    ambiguous = (complement(ref1) == alt1) & (ref1 != "X")
    fits = lambda a, b: (a == b) | (a == "X") | (b == "X")
    same, swapped = fits(ref1, ref2) & fits(alt1, alt2), fits(ref1, alt2) & fits(alt1, ref2)
    c1, c2 = complement(ref2), complement(alt2)
    out = F.when(unknown, -1)
    if strand_check:
        out = out.when(ambiguous, -2)
    return out.when(same, 1).when(swapped, 2).when(fits(ref1, c1) & fits(alt1, c2), 1).when(fits(ref1, c2) & fits(alt1, c1), 2).otherwise(0)


def chromosome(name: Column) -> Column:
    """Chromosome number of a name: chr prefixes are dropped, X, Y, MT and XY have their codes, 2A and 2B are 2."""
    bare = F.regexp_replace(F.upper(F.trim(name)), "^CHR", "")
    return (
        F.when(bare == "X", X).when(bare == "Y", Y).when(bare.isin("M", "MT"), MT).when(bare == "XY", XY)
        .when(bare.isin("2A", "2B"), 2).otherwise(F.coalesce(F.try_to_number(bare, F.lit("999")).cast("int"), F.lit(BAD)))
    )


def id_hash(ids: list[str]) -> str:
    """Order-dependent 32-bit hash of ids, in hexadecimal: per id h = 23 h + byte, over ids H = 17 H xor h."""
    total = 0
    for name in ids:
        h = 0
        for byte in name.encode():
            h = (h * 23 + byte) & 0xFFFFFFFF
        total = ((total * 17) & 0xFFFFFFFF) ^ h
    return f"{total:x}"


def id_hash_column(ids: Column) -> Column:
    """The same over an ordered array of ids."""
    m = F.lit(0xFFFFFFFF).cast("bigint")
    return F.lower(F.hex(F.aggregate(ids, F.lit(0).cast("bigint"), lambda t, s: (t * 17).bitwiseAND(m).bitwiseXOR(one_id_hash(s)))))


def one_id_hash(s: Column) -> Column:
    m = F.lit(0xFFFFFFFF).cast("bigint")
    return F.aggregate(F.split(s, ""), F.lit(0).cast("bigint"), lambda h, c: F.when(c == "", h).otherwise((h * 23 + F.ascii(c)).bitwiseAND(m)))


def ordered_hash(rows: DataFrame, name: str, order: str) -> DataFrame:
    """One row: hash of a sample or marker table's ids in file order. Ids are hashed where they are; their hashes, 12 bytes
    a row of the table, pass one task in order as a stream, as each step needs the one before."""
    own = rows.select(F.col(order).alias("o"), one_id_hash(F.col(name).cast("string")).alias("h"))

    def run(batches):
        total = 0
        for b in batches:
            for h in b.column("h").to_pylist():
                total = ((total * 17) & 0xFFFFFFFF) ^ h
        yield pa.RecordBatch.from_arrays([pa.array([f"{total:x}"])], ["hash"])

    folded = own.repartition(1).sortWithinPartitions("o", "h").select("h").mapInArrow(run, "hash string")
    return folded.agg(F.coalesce(F.max("hash"), F.lit("0")).alias("hash"))


def pair_class(a: Column, b: Column) -> Column:
    """Class of an allele pair up to strand: AC 0, AG 1, AT 2, CA 3, CG 4, CT 5; -1 for equal or unknown ones."""
    i, j = (F.array_position(F.array(*map(F.lit, "ACGT")), x).cast("int") - 1 for x in (a, b))
    turn = i > 1
    i, j = F.when(turn, 3 - i).otherwise(i), F.when(turn, 3 - j).otherwise(j)
    known = a.isin(*"ACGT") & b.isin(*"ACGT") & (a != b)
    return F.when(~F.coalesce(known, F.lit(False)), -1).when(i == 0, j - 1).when(j == 0, 3).otherwise(j + 2)
