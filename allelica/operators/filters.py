"""Marker and sample filters, as joins and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelica.operators.counts import class_counts


def chromosomes(marker: DataFrame, include: int | None = None, exclude: int | None = None, last: int = 22, x_data: bool = False) -> DataFrame:
    """Chromosome 0 and those beyond X always go; X stays when asked for."""
    out = marker.where((F.col("chrom") >= 1) & (F.col("chrom") <= last + 1))
    if include is not None:
        return out.where(F.col("chrom") == include)
    if exclude is not None:
        out = out.where(F.col("chrom") != exclude)
    return out if x_data else out.where(F.col("chrom") <= last)


def positions(marker: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    keep = F.lit(True)
    if low is not None:
        keep &= F.col("physpos") >= low
    if high is not None:
        keep &= F.col("physpos") <= high
    return marker.where(keep)


def without_listed(marker: DataFrame, bad: DataFrame) -> DataFrame:
    return marker.join(bad.select("snp").distinct(), "snp", "left_anti")


def outside_regions(marker: DataFrame, regions: DataFrame, width: int = 10_000_000) -> DataFrame:
    """Markers in none of the closed intervals (chrom, low, high).

    Intervals are laid over bins of ``width`` bases, so the range condition becomes an equi-join on
    (chrom, bin) with a residual check.
    """
    bins = regions.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    m = marker.withColumn("bin", F.floor(F.col("physpos") / width)).alias("m")
    b = bins.alias("b")
    inside = (F.col("m.chrom") == F.col("b.chrom")) & (F.col("m.bin") == F.col("b.bin")) & F.col("m.physpos").between(F.col("b.low"), F.col("b.high"))
    return m.join(b, inside, "left_anti").drop("bin")


def in_populations(sample: DataFrame, pops: list) -> DataFrame:
    return sample.where(F.col("pop").isin(pops))


def capped_samples(sample: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` samples of each population, chosen by a seeded hash."""
    draw = Window.partitionBy("pop").orderBy(F.xxhash64("sample", F.lit(seed)), "sample")
    return sample.withColumn("r", F.row_number().over(draw)).where(F.col("r") <= most).drop("r")


def max_missing(genotype: DataFrame, sample: DataFrame, share: float) -> DataFrame:
    """snp, present, missing of the markers with at most that share of samples missing."""
    n = sample.count()
    per = genotype.join(sample.select("sample"), "sample", "left_semi").groupBy("snp").agg(F.count("*").alias("present"))
    return per.withColumn("missing", F.lit(n).cast("bigint") - F.col("present")).where(F.col("missing") <= share * n)


def min_valid(genotype: DataFrame, sample: DataFrame, least: int) -> DataFrame:
    """snp, fewest of the markers with at least that many samples in every population that has samples."""
    pops = sample.select("pop").distinct().count()
    per = genotype.join(sample.select("sample", "pop"), "sample").groupBy("snp", "pop").agg(F.count("*").alias("n"))
    whole = per.groupBy("snp").agg(F.min("n").alias("fewest"), F.count("*").alias("pops"))
    return whole.where((F.col("pops") == pops) & (F.col("fewest") >= least)).select("snp", "fewest")


def hardy_weinberg(genotype: DataFrame, sample: DataFrame, limit: float) -> DataFrame:
    """snp, n, het, z of the markers whose heterozygote share differs from 2pq by at most ``limit`` errors."""
    one = class_counts(genotype, sample.withColumn("pop", F.lit(0)))
    n = F.col("x0") + F.col("x1") + F.col("x2")
    p = (2 * F.col("x2") + F.col("x1")) / (2 * n)
    expected = 2 * p * (1 - p)
    out = one.withColumns({"n": n, "het": F.col("x1") / n, "expected": expected})
    z = F.try_divide(F.abs(F.col("het") - F.col("expected")), F.sqrt(F.col("expected") * (1 - F.col("expected")) / F.col("n")))
    return out.withColumn("z", F.coalesce(z, F.lit(0.0))).where(F.col("z") <= limit).select("snp", "n", "het", "z")


def polymorphic(counts: DataFrame) -> DataFrame:
    """snp of the markers with both alleles seen."""
    return counts.groupBy("snp").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 > 0 and n1 > 0").select("snp")


def marker_weights(moments: DataFrame, outpop=None) -> DataFrame:
    """snp, weight: 1/(p(1-p)) in the outgroup, whose monomorphic markers go; 1 without an outgroup."""
    if outpop is None:
        return moments.select("snp").distinct().withColumn("weight", F.lit(1.0))
    out = moments.where((F.col("pop") == outpop) & (F.col("p") > 0) & (F.col("p") < 1))
    return out.select("snp", (1 / (F.col("p") * (1 - F.col("p")))).alias("weight"))


def distinct_positions(marker: DataFrame, name: Column) -> DataFrame:
    """One marker per position: the shortest name, of equally long ones the greatest."""
    rank = Window.partitionBy("chrom", "physpos").orderBy(F.length(name), name.desc())
    return marker.withColumn("r", F.row_number().over(rank)).where("r = 1").drop("r")


def thinned(marker: DataFrame, distance: int) -> DataFrame:
    """Markers at least ``distance`` apart in genpos, taken greedily along each chromosome."""
    from allelica.operators.blocks import assign_blocks

    blocked = assign_blocks(marker, distance)
    first = Window.partitionBy("block").orderBy("genpos", "physpos", "snp")
    return blocked.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "block")


def chromosome_range(marker: DataFrame, low: int, high: int) -> DataFrame:
    return marker.where(F.col("chrom").between(low, high))


def listed_samples(sample: DataFrame, names: DataFrame) -> DataFrame:
    """The samples on a list; it overrides any choice by population."""
    return sample.join(names.select("sample").distinct(), "sample", "left_semi")


def without_male_x_hets(genotype: DataFrame, sample: DataFrame, marker: DataFrame, x: int = 23) -> DataFrame:
    """The calls without heterozygous ones of males (sex M) on chromosome ``x``: those become missing."""
    on_x = marker.where(F.col("chrom") == x).select("snp", F.lit(True).alias("on_x"))
    males = sample.where("sex = 'M'").select("sample", F.lit(True).alias("male"))
    rows = genotype.join(on_x, "snp", "left").join(males, "sample", "left")
    return rows.where((F.col("g") != 1) | F.col("on_x").isNull() | F.col("male").isNull()).select("snp", "sample", "g")


def explicit_weights(counts: DataFrame, outpop) -> DataFrame:
    """snp, weight: (a+b+2)(a+b+1) / ((a+1)(b+1)) of the outgroup's allele counts, the expected 1/(p(1-p)) under
    a flat prior, scaled to mean 1 over the markers."""
    a, b = F.coalesce("n0", F.lit(0)), F.coalesce("n1", F.lit(0))
    raw = (a + b + 2) * (a + b + 1) / ((a + 1) * (b + 1))
    every = counts.select("snp").distinct().join(counts.where(F.col("pop") == outpop), "snp", "left").select("snp", raw.alias("raw"))
    mean = every.agg(F.avg("raw")).first()[0]
    return every.select("snp", (F.col("raw") / F.lit(mean)).alias("weight"))


def allele_pairs(marker: DataFrame, mode: int) -> DataFrame:
    """Markers whose pair of alleles the mode allows: 0 any, 1 the transversion classes AC, AT and CA, 2 all but
    the transitions, 10 + k only class k, 99 also pairs that have no class."""
    from allelica.functions.alleles import pair_class

    c = pair_class(F.col("ref"), F.col("alt"))
    if mode == 99:
        return marker
    if mode >= 10:
        return marker.where(c == mode - 10)
    keep = {0: c >= 0, 1: c.isin(0, 2, 3), 2: (c >= 0) & ~c.isin(1, 5)}
    return marker.where(keep[mode])


def legal_tuple(types: Column, bankers: int) -> Column:
    """Whether four populations of kinds 0, 1 and 2 (banker) may form a query: one of kind 1 at least, and two
    bankers or all the ``bankers`` there are. ``types`` is the array of the four kinds, bankers distinct."""
    count = lambda k: F.size(F.filter(types, lambda t: t == k))
    return (count(1) > 0) & ((count(2) >= 2) | (count(2) == bankers))


def _walked(batches):
    """snp of the markers that go, from pairs in the order of chromosome, first and second marker. From batch to batch
    stay the pairs of one first marker and the removed markers that later pairs may name."""
    import pandas as pd

    on = first = None
    rows, gone, limit = [], set(), 1024

    def removed() -> list:
        live = [r for r in rows if r[:2] not in gone]
        if first is None or first[:2] in gone or not live:
            return []
        out = [first] if max(r[2] for r in live) > first[2] else live
        gone.update(r[:2] for r in out)
        return [r[1] for r in out]

    columns = ["chrom", "ord1", "snp1", "score1", "ord2", "snp2", "score2"]
    for pdf in batches:
        out = []
        for chrom, o1, s1, c1, o2, s2, c2 in zip(*(pdf[c].tolist() for c in columns), strict=True):
            if chrom != on or (o1, s1) != first[:2]:
                out += removed()
                if chrom != on:
                    gone.clear()
                elif len(gone) > limit:
                    gone.difference_update([k for k in gone if k[0] < o1])
                    limit = 2 * len(gone) + 1024
                on, first, rows = chrom, (o1, s1, c1), []
            rows.append((o2, s2, c2))
        yield pd.DataFrame({"snp": out}, dtype="int64")
    yield pd.DataFrame({"snp": removed()}, dtype="int64")


def linked_prune(scores: DataFrame, linked: DataFrame) -> DataFrame:
    """snp of the markers that stay after pruning. ``scores`` has (snp, chrom, ord, score), ``linked`` the pairs
    (snp1, snp2, chrom) within the window whose correlation is too high, in either order. Markers of one ord
    are ordered by snp.

    Along a chromosome each marker that is still there looks at the later ones it is linked to: if one of
    them has a greater score it goes itself, else they go. Pairs come from a distributed band join and are sorted by
    Spark, which spills; the walk reads a chromosome's pairs as a stream and holds the removed markers that a window's
    pairs can still name, however long the chromosome. Markers without pairs never reach it.
    """
    one = scores.select(F.col("snp").alias("snp1"), F.col("ord").alias("ord1"), F.col("score").alias("score1"))
    two = scores.select(F.col("snp").alias("snp2"), F.col("ord").alias("ord2"), F.col("score").alias("score2"))
    both = linked.select("snp1", "snp2", "chrom").join(one, "snp1").join(two, "snp2").where("snp1 <> snp2")
    a, b = (F.struct(*(F.col(f"{c}{k}").alias(c) for c in ("ord", "snp", "score"))) for k in (1, 2))
    ends = both.select("chrom", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    pairs = ends.select("chrom", *(F.col(f"{e}.{c}").alias(f"{c}{k}") for k, e in ((1, "a"), (2, "b")) for c in ("ord", "snp", "score")))
    gone = pairs.repartition("chrom").sortWithinPartitions("chrom", "ord1", "snp1", "ord2", "snp2").mapInPandas(_walked, "snp bigint")
    return scores.select("snp").join(gone, "snp", "left_anti")
