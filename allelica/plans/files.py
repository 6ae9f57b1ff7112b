"""Queries of file formats: the test tables written in a format, read again and compared with themselves."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelica.plans import oracle as o
from allelica.plans.queries import alleles, query
from allelica.sources import adapter, formats


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or a temporary one of a local session without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="allelica-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def dataset(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, markers and samples of the test tables with places and names as files have them."""
    d = adapter.load(spark, sf_dir)
    # Ids of the tables run from 0 without gaps, as places do.
    marker = alleles(d).select("snp", "chrom", (F.col("genpos") / F.lit(1e7)).alias("genpos"), "physpos", "ref", "alt", F.col("snp").alias("ord"))
    sample = d.sample.select("sample", "sex", "pop", F.col("sample").alias("ord"))
    own = lambda table, name: formats.beside(table.select(name), table.count())
    held = d.genotype.join(own(d.marker, "snp"), "snp", "left_semi").join(own(d.sample, "sample"), "sample", "left_semi")
    return held, marker, sample


_CALLS = o.ADAPTER + "SELECT snp, sample, g FROM genotype WHERE snp IN (SELECT snp FROM marker) AND sample IN (SELECT sample FROM sample)"


def _again(spark, sf_dir, kind):
    g, marker, sample = dataset(spark, sf_dir)
    path = scratch(spark)
    formats.write_packed(g, marker, sample, path, kind)
    return formats.read_packed(spark, path, marker, sample)


@query(_CALLS)
def packed_geno_again(spark, sf_dir):
    return _again(spark, sf_dir, "GENO")


@query(_CALLS)
def packed_bed_again(spark, sf_dir):
    return _again(spark, sf_dir, "BED")


@query(_CALLS)
def transposed_again(spark, sf_dir):
    """GENO, turned to TGENO, turned back, read."""
    g, marker, sample = dataset(spark, sf_dir)
    first, second, third = (scratch(spark) for _ in range(3))
    formats.write_packed(g, marker, sample, first, "GENO")
    formats.transpose_packed(spark, first, second)
    formats.transpose_packed(spark, second, third)
    return formats.read_packed(spark, third, marker, sample)


@query(o.ADAPTER + "SELECT sample, COUNT(*) AS calls, CAST(SUM(g) AS BIGINT) AS alleles FROM genotype WHERE snp IN (SELECT snp FROM marker) AND sample IN (SELECT sample FROM sample WHERE pop = 2) GROUP BY 1")
def transposed_population(spark, sf_dir):
    """One population of a TGENO dataset: only its samples' rows are read."""
    g, marker, sample = dataset(spark, sf_dir)
    path = scratch(spark)
    formats.write_packed(g, marker, sample, path, "TGENO")
    calls = formats.read_packed(spark, path, marker, sample.where("pop = 2"), check=False)
    return calls.groupBy("sample").agg(F.count("*").alias("calls"), F.sum("g").alias("alleles"))


@query(_CALLS)
def eigenstrat_again(spark, sf_dir):
    g, marker, sample = dataset(spark, sf_dir)
    path = scratch(spark)
    formats.write_eigenstrat(g, marker, sample, path)
    return formats.read_eigenstrat(spark, path, marker, sample)


@query(_CALLS)
def ancestrymap_again(spark, sf_dir):
    g, _, _ = dataset(spark, sf_dir)
    path = scratch(spark)
    formats.write_ancestrymap(g, path)
    return formats.read_ancestrymap(spark, path).select(F.col("snp").cast("bigint").alias("snp"), F.col("sample").cast("bigint").alias("sample"), "g")


@query(o.ADAPTER + """, letters AS (SELECT snp, chrom, physpos, genpos, ['A','C','G','T'][snp % 4 + 1] AS ref, ['A','C','G','T'][(snp + 1 + snp % 2) % 4 + 1] AS alt FROM marker)
SELECT CAST(snp AS VARCHAR) AS snp, chrom, physpos, ROUND(FLOOR(genpos / 100) / 1e5, 6) AS genpos, ref, alt, snp AS ord FROM letters""")
def snp_file_again(spark, sf_dir):
    """A marker file: lines in order, chromosomes and positions parsed, places numbered by the file's splits. It is
    written in Morgans, of which large tables have more than the 100 that a file of unknown unit can."""
    _, marker, _ = dataset(spark, sf_dir)
    marker = marker.withColumn("genpos", F.floor(F.round(F.col("genpos") * 1e7) / 100) / 1e5)  # as many digits as lines have
    path = scratch(spark)
    formats.snp_lines(marker).write.text(path)
    return formats.read_snp(spark, path, morgans=True).withColumn("genpos", F.round("genpos", 6)).select("snp", "chrom", "physpos", "genpos", "ref", "alt", "ord")


@query(o.ADAPTER + "SELECT CAST(s.sample AS VARCHAR) AS sample, CASE WHEN s.sample % 2 = 1 THEN 'M' ELSE 'F' END AS sex, CAST(pop AS VARCHAR) AS pop, s.sample AS ord FROM sample s")
def ind_file_again(spark, sf_dir):
    _, _, sample = dataset(spark, sf_dir)
    path = scratch(spark)
    formats.ind_lines(sample).write.text(path)
    return formats.read_ind(spark, path).select("sample", "sex", "pop", "ord")


@query(o.ADAPTER + """, s AS (SELECT snp, SUM(n0) AS n0, SUM(n1) AS n1 FROM counts GROUP BY 1)
SELECT snp, ROUND(n1 / CAST(n0 + n1 AS DOUBLE), 6) AS value FROM s""")
def marker_values_again(spark, sf_dir):
    """A file of values by marker."""
    g, _, _ = dataset(spark, sf_dir)
    path = scratch(spark)
    formats.value_lines(g.groupBy("snp").agg((F.sum("g") / (2 * F.count("*"))).alias("value"))).write.text(path)
    return formats.read_values(spark, path).select(F.col("snp").cast("bigint").alias("snp"), F.round("value", 6).alias("value"))


