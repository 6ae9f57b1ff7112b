"""Queries of filters and transforms whose result SQL can state, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelica.operators import counts, filters, merges, transforms
from allelica.plans import oracle as o
from allelica.plans.queries import alleles, alleles2, query
from allelica.sources import adapter


@query(o.ADAPTER + "SELECT snp FROM counts GROUP BY 1 HAVING SUM(n0) > 0 AND SUM(n1) > 0")
def polymorphic_markers(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return filters.polymorphic(counts.allele_counts(d.genotype, d.sample))


@query(o.ADAPTER + "SELECT pop, LEAST(COUNT(*), 12) AS samples FROM sample GROUP BY 1")
def samples_capped(spark, sf_dir):
    """The number of samples of each population that a cap leaves; which ones is a hash's choice."""
    return filters.capped_samples(adapter.load(spark, sf_dir).sample, 12).groupBy("pop").agg(F.count("*").alias("samples"))


@query(o.ADAPTER + "SELECT pop, COUNT(*) AS calls, CAST(SUM(g) AS BIGINT) AS alleles FROM genotype JOIN sample USING (sample) WHERE pop IN (1, 3) GROUP BY 1")
def calls_of_populations(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    own = filters.in_populations(d.sample, [1, 3]).select("sample", "pop")
    return d.genotype.join(own, "sample").groupBy("pop").agg(F.count("*").alias("calls"), F.sum("g").alias("alleles"))


@query(o.ADAPTER + "SELECT snp, sample, g FROM genotype WHERE g <> 1")
def hets_dropped(spark, sf_dir):
    return transforms.hets_to(adapter.load(spark, sf_dir).genotype, "missing")


@query(o.ADAPTER + "SELECT snp, sample, CASE WHEN snp IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) THEN 2 - g ELSE g END AS g FROM genotype")
def flipped_markers(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    listed = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity = 50").select(F.col("l_partkey").alias("snp"))
    return transforms.flip(d.genotype, listed)


@query(o.ADAPTER + f", codes AS (SELECT snp, {o.CODE} AS code FROM alleles2 a JOIN alleles b USING (snp)) SELECT snp, sample, CASE WHEN code = 2 THEN 2 - g ELSE g END AS g FROM genotype JOIN codes USING (snp) WHERE code > 0")
def markers_remapped(spark, sf_dir):
    """Calls turned to the alleles of another marker table."""
    d = adapter.load(spark, sf_dir)
    return merges.remapped(d.genotype, alleles(d), alleles2(d))


@query(o.ADAPTER + "SELECT snp, sample, g FROM genotype")
def haploid_and_back(spark, sf_dir):
    """Each sample split in two haploid ones and joined again."""
    d = adapter.load(spark, sf_dir)
    out = transforms.to_diploid(transforms.to_haploid(d.genotype))
    return out.withColumn("sample", F.col("sample").cast("bigint"))
