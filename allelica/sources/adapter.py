"""Genotype relations over the star-schema test tables, so that every query runs on them.

genotype(snp, sample, g) has a row per call (a missing call has no row), sample(sample, pop, sex, affected), and
marker(snp, chrom, physpos, genpos) with genpos in 1e-7 Morgan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Lines of a partition of calls.
LINES = 250_000


@dataclass
class Dataset:
    genotype: DataFrame
    sample: DataFrame
    marker: DataFrame


def load(spark: SparkSession, sf_dir: str) -> Dataset:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    calls = read("lineitem").select(
        F.col("l_partkey").alias("snp"), F.col("l_suppkey").alias("sample"), (F.col("l_quantity").cast("bigint") % 3).alias("g")
    )
    genotype = dealt(calls).groupBy("snp", "sample").agg(F.min("g").alias("g"))
    nation = read("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("bigint").alias("pop"))
    sample = read("supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("sample"), "pop", "s_nationkey", F.when(F.col("s_suppkey") % 2 == 1, "M").otherwise("F").alias("sex"), (F.col("s_nationkey") % 2).cast("bigint").alias("affected"))
    part = read("part")
    n = part.count()
    key = F.col("p_partkey")
    physpos = key * 200_000 + ((key * 7919) % 10_000) * 10
    marker = part.select(
        key.alias("snp"), (1 + F.floor(key * 22 / F.lit(float(n)))).cast("bigint").alias("chrom"), physpos.alias("physpos"),
        (F.floor(physpos / 10)).cast("bigint").alias("genpos"),
    )
    return Dataset(genotype, sample, marker)


def dealt(calls: DataFrame) -> DataFrame:
    """The lines by marker and sample, in partitions whose number grows with the lines: a task that groups them, or joins
    two datasets dealt alike, holds about ``LINES`` calls whatever the input. Few lines share a call, so sums within a
    file's split would save nothing and hold the whole split."""
    return calls.repartition(calls.count() // LINES + 1, "snp", "sample")


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another genotype relation for merges, from all lines: other calls, and ids shifted so that each dataset has
    markers and samples that the other lacks."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    calls = rows.select((F.col("l_partkey") + 50).alias("snp"), (F.col("l_suppkey") + 3).alias("sample"), (F.col("l_orderkey") % 3).alias("g"))
    return dealt(calls).groupBy("snp", "sample").agg(F.max("g").alias("g"))
