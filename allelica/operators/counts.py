"""Allele counts, genotype classes and per-population moments; one shuffle over the calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allele_counts(genotype: DataFrame, sample: DataFrame, haploid: Column | None = None) -> DataFrame:
    """snp, pop, n0 (other allele), n1 (reference). Where ``haploid`` holds, a call is one allele and a
    heterozygous one is dropped."""
    rows = genotype.join(sample.select("sample", "pop", *([haploid.alias("haploid")] if haploid is not None else [])), "sample")
    one = F.col("g")
    if haploid is None:
        return rows.groupBy("snp", "pop").agg(F.sum(2 - one).alias("n0"), F.sum(one).alias("n1"))
    rows = rows.where(~(F.col("haploid") & (one == 1)))
    half = F.when(F.col("haploid"), one / 2).otherwise(one).cast("bigint")
    alleles = F.when(F.col("haploid"), 1).otherwise(2)
    return rows.groupBy("snp", "pop").agg(F.sum(alleles - half).alias("n0"), F.sum(half).alias("n1"))


def one_allele_counts(genotype: DataFrame, sample: DataFrame, seed: int = 0) -> DataFrame:
    """Counts with one allele drawn from each sample; a heterozygote's coin is a hash of marker and sample."""
    coin = F.pmod(F.xxhash64("snp", "sample", F.lit(seed)), F.lit(2))
    drawn = genotype.withColumn("g", F.when(F.col("g") == 1, coin).otherwise(F.col("g") / 2).cast("bigint"))
    rows = drawn.join(sample.select("sample", "pop"), "sample")
    return rows.groupBy("snp", "pop").agg(F.sum(1 - F.col("g")).alias("n0"), F.sum("g").alias("n1"))


def class_counts(genotype: DataFrame, sample: DataFrame) -> DataFrame:
    """snp, pop, x0, x1, x2: samples by genotype."""
    rows = genotype.join(sample.select("sample", "pop"), "sample")
    return rows.groupBy("snp", "pop").agg(*[F.sum((F.col("g") == k).cast("bigint")).alias(f"x{k}") for k in range(3)])


def moments(counts: DataFrame) -> DataFrame:
    """Adds n, p (reference frequency), h (half heterozygosity, null below two alleles) and c, the
    correction wherever a population stands squared."""
    n = F.col("n0") + F.col("n1")
    p = F.col("n1") / n
    h = F.when(n >= 2, F.col("n0") * F.col("n1") / (n * (n - 1)))
    return counts.withColumns({"n": n, "p": p, "h": h}).withColumn("c", F.col("p") - F.col("h") - F.col("p") * F.col("p"))


def inbred_moments(classes: DataFrame) -> DataFrame:
    """The same from genotype classes of inbred samples: two alleles of one sample are never compared.

    Hemizygous samples, where there are columns w0 and w1 of them, have one allele each.
    """
    w0, w1 = (F.col(c) if c in classes.columns else F.lit(0) for c in ("w0", "w1"))
    x0, x1, x2 = F.col("x0"), F.col("x1"), F.col("x2")
    f, m = x0 + x1 + x2, w0 + w1
    n0, n1 = 2 * x0 + x1 + w0, 2 * x2 + x1 + w1
    pairs = 4 * x0 * x2 + 2 * x2 * x1 + 2 * x0 * x1 + x1 * (x1 - 1) + (2 * x0 + x1) * w1 + (2 * x2 + x1) * w0 + w0 * w1
    all_pairs = 4 * f * (f - 1) + 4 * f * m + m * (m - 1)
    out = classes.withColumns({"n0": n0, "n1": n1, "n": n0 + n1, "p": n1 / (n0 + n1), "h": F.when(f + m >= 2, F.try_divide(pairs, all_pairs))})
    return out.withColumn("c", F.col("p") - F.col("h") - F.col("p") * F.col("p"))


def hemizygous_classes(genotype: DataFrame, sample: DataFrame, haploid: Column) -> DataFrame:
    """snp, pop, x0, x1, x2 of diploid samples and w0, w1 of those for which ``haploid`` holds; a heterozygous
    call of the latter is dropped."""
    rows = genotype.join(sample.select("sample", "pop", haploid.alias("haploid")), "sample")
    count = lambda on, name: F.sum(on.cast("bigint")).alias(name)
    g, own = F.col("g"), F.col("haploid")
    return rows.groupBy("snp", "pop").agg(*[count(~own & (g == k), f"x{k}") for k in range(3)], count(own & (g == 0), "w0"), count(own & (g == 2), "w1"))


def by_marker(stats: DataFrame, keys: tuple[str, ...] = ("snp", "block")) -> DataFrame:
    """One row per marker with ``m``, a map from population to its counts and moments.

    Every tuple of populations is then a projection of this row, without a self-join per population. The
    collected list has a row per population.
    """
    fields = F.struct(*[c for c in ("n0", "n1", "n", "p", "h", "c") if c in stats.columns])
    return stats.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pop", fields))).alias("m"))
