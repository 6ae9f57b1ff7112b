"""Merging datasets: genotype relations (snp, sample, g) with marker tables (snp, ref, alt, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelica.functions.alleles import match_code


def flipped(code: Column, g: Column) -> Column:
    return F.when(code == 2, 2 - g).otherwise(g)


def merge(g1: DataFrame, m1: DataFrame, g2: DataFrame, m2: DataFrame, allow_dups: bool = False, strand_check: bool = True, check_positions: bool = True) -> DataFrame:
    """Calls of both datasets at the markers they share with matching alleles; the second's are flipped
    where its alleles are swapped. A sample in both is refused, or with ``allow_dups`` only fills the
    calls that the first lacks. Positions of shared markers that differ are refused, unless ``check_positions`` is
    false."""
    both = m1.alias("a").join(m2.alias("b"), "snp").select("snp", *[F.col(f"{s}.{c}").alias(f"{c}{n}") for s, n in (("a", 1), ("b", 2)) for c in ("ref", "alt", "chrom", "physpos")])
    if check_positions and not both.where("chrom1 <> chrom2 or physpos1 <> physpos2").isEmpty():
        raise ValueError("chromosomes or positions of shared markers differ")
    shared = both.select("snp", match_code(F.col("ref1"), F.col("alt1"), F.col("ref2"), F.col("alt2"), strand_check).alias("code")).where("code > 0")
    if not allow_dups and not g1.select("sample").distinct().join(g2.select("sample").distinct(), "sample", "left_semi").isEmpty():
        raise ValueError("a sample is in both datasets")
    first = g1.join(shared.select("snp"), "snp", "left_semi")
    second = g2.join(shared, "snp").select("snp", "sample", flipped(F.col("code"), F.col("g")).alias("g"))
    full = first.alias("a").join(second.alias("b"), ["snp", "sample"], "full")
    return full.select("snp", "sample", F.coalesce("a.g", "b.g").alias("g"))


def multi_merge(parts: list[DataFrame]) -> DataFrame:
    """Outer union of several genotype relations: of a call's values the first dataset's stays. One shuffle."""
    union = reduce(DataFrame.unionByName, [p.select("snp", "sample", "g").withColumn("at", F.lit(k)) for k, p in enumerate(parts)])
    return union.groupBy("snp", "sample").agg(F.min_by("g", "at").alias("g"))


def marker_union(g1: DataFrame, g2: DataFrame) -> DataFrame:
    """Samples in both, markers in either; the first dataset's calls stand at its own markers."""
    samples = g1.select("sample").distinct().join(g2.select("sample").distinct(), "sample", "left_semi")
    more = g2.join(g1.select("snp").distinct(), "snp", "left_anti")
    return g1.unionByName(more).join(samples, "sample", "left_semi").select("snp", "sample", "g")


def stacked(g1: DataFrame, m1: DataFrame, g2: DataFrame, m2: DataFrame) -> DataFrame:
    """Samples of two datasets with one and the same marker table."""
    if m1.select("snp").exceptAll(m2.select("snp")).union(m2.select("snp").exceptAll(m1.select("snp"))).isEmpty():
        return g1.unionByName(g2)
    raise ValueError("the marker tables differ")


def remapped(genotype: DataFrame, marker: DataFrame, target: DataFrame) -> DataFrame:
    """Calls at the target's markers, flipped to its alleles; markers that do not match have no calls."""
    m, t = marker.alias("m"), target.alias("t")
    code = match_code(F.col("t.ref"), F.col("t.alt"), F.col("m.ref"), F.col("m.alt"), False)
    codes = t.join(m, "snp").select("snp", code.alias("code")).where("code > 0")
    return genotype.join(codes, "snp").select("snp", "sample", flipped(F.col("code"), F.col("g")).alias("g"))


def remap_samples(genotype: DataFrame, names: DataFrame, check: bool = True) -> DataFrame:
    """Calls under new sample names: ``names`` has a row (sample, new) for each new sample, an old one may stand
    several times. With ``check`` every old sample must be named and every name must have calls."""
    if check:
        old, listed = genotype.select("sample").distinct(), names.select("sample").distinct()
        if not (old.join(listed, "sample", "left_anti").isEmpty() and listed.join(old, "sample", "left_anti").isEmpty()):
            raise ValueError("the samples and the list of names differ")
    return genotype.join(names.select("sample", "new"), "sample").select("snp", F.col("new").alias("sample"), "g")
