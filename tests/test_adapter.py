"""What a task holds when the star-schema tables become calls."""

from allelica.operators import merges, transforms
from allelica.sources import adapter
from tests.conftest import SF


def test_partitions_grow_with_the_lines(spark, monkeypatch):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(adapter, "LINES", 500)
    first, second = adapter.load(spark, SF).genotype, adapter.second(spark, SF)
    both = merges.multi_merge([second, first])
    assert [d.rdd.getNumPartitions() for d in (first, second)] == [lines // 500 + 1] * 2
    largest = max(both.rdd.glom().map(len).collect())
    assert 0 < largest < 4 * 500


def test_joined_haploid_samples_are_one_aggregate(spark):
    """Both sides must be called; no rows are made for each distinct side."""
    rows = [(1, "a:A", 2), (1, "a:B", 0), (1, "b:A", 2), (2, "b:A", 2), (2, "b:B", 2), (2, "b:C", 2), (3, "c:A", 0), (3, "c:A", 0)]
    out = transforms.to_diploid(spark.createDataFrame(rows, "snp bigint, sample string, g bigint"))
    assert sorted(map(tuple, out.collect())) == [(1, "a", 1), (2, "b", 2)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Expand" not in plan
