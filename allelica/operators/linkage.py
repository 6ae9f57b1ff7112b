"""Linkage between nearby markers: a band self-join in genetic distance, pair tables, haplotype EM and decay by bins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelica.functions import two_locus
from allelica.operators import tiles


def marker_pairs(marker: DataFrame, most: int) -> DataFrame:
    """snp1, snp2, chrom, distance of markers on a chromosome with 0 < distance < ``most`` in genpos.

    Markers are cut into buckets of that width; each meets its own and the next bucket, so the band
    condition is an equi-join with a residual check.
    """
    bucket = F.floor(F.col("genpos") / most)
    a = marker.select(F.col("snp").alias("snp1"), "chrom", F.col("genpos").alias("g1"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    b = marker.select(F.col("snp").alias("snp2"), "chrom", F.col("genpos").alias("g2"), bucket.alias("bucket"))
    pairs = a.join(b, ["chrom", "bucket"]).where(f"g2 > g1 and g2 - g1 < {int(most)}")
    return pairs.select("snp1", "snp2", "chrom", (F.col("g2") - F.col("g1")).alias("distance"))


def pair_tables(genotype: DataFrame, marker: DataFrame, most: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """snp1, snp2, chrom, distance, n and the sums x, y, xx, yy, xy of the calls over common samples, of markers of a
    chromosome with 0 < distance < ``most``; from the nine counts of packed tiles. ``carry`` as in ``pair_cells``."""
    return table_sums(tiles.pair_cells(genotype, marker, most, carry=carry), carry=carry)


def table_sums(cells: DataFrame, name: str = "cells0", carry: tuple[str, ...] = ()) -> DataFrame:
    """n, x, y, xx, yy, xy of the nine counts in ``name``."""
    total = lambda weight: sum((weight(k // 3, k % 3) * F.col(name)[k] for k in range(9) if weight(k // 3, k % 3)), F.lit(0).cast("bigint"))
    sums = {"n": lambda g, h: 1, "x": lambda g, h: g, "y": lambda g, h: h, "xx": lambda g, h: g * g, "yy": lambda g, h: h * h, "xy": lambda g, h: g * h}
    held = [f"{c}{k}" for c in carry for k in (1, 2)]
    return cells.select("snp1", "snp2", "chrom", "distance", *held, *[total(w).alias(c) for c, w in sums.items()]).where("n > 0")


def _moments() -> tuple[Column, ...]:
    """n, covariance and variances' product times n squared, in doubles: the integers pass 64 bits with many samples."""
    n, x, y, xx, yy, xy = (F.col(c).cast("double") for c in ("n", "x", "y", "xx", "yy", "xy"))
    return n, n * xy - x * y, (n * xx - x * x) * (n * yy - y * y)


def r_squared(tables: DataFrame) -> DataFrame:
    _, cov, var = _moments()
    return tables.withColumn("r2", F.when(var > 0, cov * cov / var))


def frequency_difference(moments: DataFrame, one, two) -> DataFrame:
    """snp, weight: the difference of two populations' reference frequencies, of markers that have both."""
    of = lambda pop: F.max(F.when(F.col("pop") == pop, F.col("p")))
    both = moments.where(F.col("pop").isin(one, two)).groupBy("snp").agg(of(one).alias("a"), of(two).alias("b"))
    return both.select("snp", (F.col("a") - F.col("b")).alias("weight")).where("weight is not null")


def decay_sums(tables: DataFrame, bin_size: int) -> DataFrame:
    """chrom, bin, pairs and the sums lw, ww, ll of the pairs' covariances and of the products of their markers' weights
    (weight1, weight2): a row for each chromosome and bin, added up where the pairs are."""
    rows = tables.where("n >= 4 and weight1 is not null and weight2 is not null")
    rows = rows.select("chrom", F.floor(F.col("distance") / bin_size).alias("bin"), ((F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("n") - 1)).alias("ld"), (F.col("weight1") * F.col("weight2")).alias("w"))
    return rows.groupBy("chrom", "bin").agg(F.count("*").alias("pairs"), F.sum(F.col("ld") * F.col("w")).alias("lw"), F.sum(F.col("w") * F.col("w")).alias("ww"), F.sum(F.col("ld") * F.col("ld")).alias("ll"))


def decay(sums: DataFrame) -> DataFrame:
    """bin, pairs, regression, correlation: pairs' covariances against the product of their weights
    (reference frequency differences), with uncentred sums per distance bin, from ``decay_sums``."""
    own = sums.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("pairs", "lw", "ww", "ll")])
    return own.select("bin", "pairs", F.try_divide("lw", "ww").alias("regression"), F.try_divide(F.col("lw"), F.sqrt(F.col("ww") * F.col("ll"))).alias("correlation"))


def chi_square(tables: DataFrame) -> DataFrame:
    """Pairs with ``chi2``, n times the squared correlation; null where a marker does not vary."""
    n, cov, var = _moments()
    return tables.withColumn("chi2", F.when(var > 0, n * (cov * cov) / var))


def decay_without_each(sums: DataFrame) -> DataFrame:
    """chrom, bin, pairs, regression: the decay table with each chromosome left out, the sums (``decay_sums``) of all
    others; what a jackknife of the date over chromosomes fits. The sums are read once, so pairs are
    counted once."""
    # A row for each bin and chromosome: every row gets the list of chromosomes, and a bin those that lack it too.
    listed = sums.withColumn("every", F.collect_set("chrom").over(Window.partitionBy()))
    grid = listed.groupBy("bin").agg(F.collect_list(F.struct("chrom", "pairs", "lw", "ww")).alias("own"), F.first("every").alias("every"))
    grid = grid.select("bin", "own", F.explode("every").alias("chrom"))
    rest = grid.select("chrom", "bin", F.filter("own", lambda x: x["chrom"] != F.col("chrom")).alias("rest")).where(F.size("rest") > 0)
    total = lambda c, zero: F.aggregate(F.col(f"rest.{c}"), zero, lambda a, x: a + x)
    return rest.select("chrom", "bin", total("pairs", F.lit(0).cast("bigint")).alias("pairs"), F.try_divide(total("lw", F.lit(0.0)), total("ww", F.lit(0.0))).alias("regression"))


def _per_table(pairs: DataFrame, names: list[str], found: list[str], run) -> DataFrame:
    """``pairs`` with new double columns that ``run`` makes of batches of count tables; nan becomes null."""

    def batches_of(batches):
        for b in batches:
            tables = [b.column(c).flatten().to_numpy().reshape(-1, 9) for c in names]
            columns = [pa.array(x, pa.float64(), from_pandas=True) for x in run(*tables)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *found])

    fields = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes)
    return pairs.mapInArrow(batches_of, f"{fields}, {', '.join(f'{c} double' for c in found)}")


def linkage_em(pairs: DataFrame, group: int = 0) -> DataFrame:
    """``pairs`` of ``tiles.pair_cells`` with ``ratio`` (twice the gain in log likelihood by linkage), ``z`` (its root,
    signed) and ``dprime`` of the group's haplotype frequencies by EM; null where fewer than three samples have both
    calls."""

    def run(tables: np.ndarray):
        out = two_locus.linkage(tables)
        return out.ratio, out.z, out.dprime

    return _per_table(pairs, [f"cells{group}"], ["ratio", "z", "dprime"], run)


def _minor(name: str, first: bool) -> Column:
    """Copies of the rarer allele at the first or second marker of a table."""
    copies = sum((((k // 3) if first else k % 3) * F.col(name)[k] for k in range(9)), F.lit(0))
    total = 2 * F.aggregate(name, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.least(copies, total - copies)


def score_decay(
    pairs: DataFrame, weights: DataFrame | None, bin_size: int, least: int = 5, parents: tuple[int, ...] = (), most_linked: float = 6.0, parent_calls: int = 10
) -> DataFrame:
    """bin, pairs, z, regression, correlation: the pairs' linkage z in the first group against the product of their
    markers' weights, by bins of the distance. ``z`` is sum(wz) over the root of sum(ww). Without ``weights`` (snp,
    weight) the pairs carry weight1 and weight2, and none of them is shuffled.

    Pairs need four samples with both calls and ``least`` copies of the rarer allele at both markers. Where ``parents``
    are given, a pair also needs ``parent_calls`` samples with both calls in each of these groups, and a likelihood
    ratio below ``most_linked`` in them: what is linked in the parents says nothing of the mixture's age. The parents'
    EM runs over pairs that pass the counts alone.
    """
    count = lambda k: F.aggregate(f"cells{k}", F.lit(0).cast("bigint"), lambda s, x: s + x)
    use = pairs.where((count(0) >= 4) & (_minor("cells0", True) >= least) & (_minor("cells0", False) >= least))
    for k in parents:
        use = use.where(count(k) >= parent_calls)
    for k in (1, 2) if weights is not None else ():
        use = use.join(weights.select(F.col("snp").alias(f"snp{k}"), F.col("weight").alias(f"weight{k}")), f"snp{k}")
    use = use.where("weight1 <> 0 and weight2 <> 0")
    for k in parents:
        found = linkage_em(use, k)
        use = found.where(F.coalesce("ratio", F.lit(-1.0)) < most_linked).select(*use.columns)
    rows = linkage_em(use).select(F.floor(F.col("distance") / bin_size).alias("bin"), "z", (F.col("weight1") * F.col("weight2")).alias("w"))
    sums = rows.groupBy("bin").agg(F.count("*").alias("pairs"), F.sum(F.col("w") * F.col("z")).alias("wz"), F.sum(F.col("w") * F.col("w")).alias("ww"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    return sums.select(
        "bin", "pairs", (F.col("wz") / F.sqrt("ww")).alias("z"), (F.col("wz") / F.col("ww")).alias("regression"), F.try_divide(F.col("wz"), F.sqrt(F.col("ww") * F.col("zz"))).alias("correlation")
    )


def epistasis(pairs: DataFrame, case: int = 1, control: int = 0, small: float = 0.1) -> DataFrame:
    """``pairs`` with ``interaction``: twice the gain in log likelihood of a logistic model with a cell for every pair of
    genotypes over one in which the two markers' effects add up, from the tables of cases and of controls."""
    return _per_table(pairs, [f"cells{case}", f"cells{control}"], ["interaction"], lambda a, b: (two_locus.interaction(a, b, small),))
