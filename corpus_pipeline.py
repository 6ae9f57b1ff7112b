"""The corpus pipeline: each stage applies one operator to all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Between stages the rows are written as Parquet and read again. A stage removes the scratch tables that its
result does not read; those that it does read stay until ``run`` has written the result, or, where a stage is called
by itself, for as long as the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from allelica.llm import decontaminate, quality_rules, shard_table, simhash_dedup, source_mix
from allelica.llm.common import discard, noted, scratch, scratch_dir, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep most of their words; lines above the limits are cut.

    Null and empty texts go; rows of null or repeated ids are judged each by itself; an empty table stays empty;
    further columns, of whatever name, are passed on.
    """
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints, the one with the least id and the first of several with it.

    Null and empty texts are one group; a group without ids keeps its first row; an empty table stays empty;
    further columns are passed on.
    """
    return simhash_dedup.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts and all rows of an empty benchmark stay; each row is judged by its text alone; further
    columns are passed on.
    """
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: not at all, once or twice.

    Null sources are a source; null texts have size 0; of repeated rows as many are taken as the budget asks
    for; an empty table stays empty; further columns are passed on.
    """
    return source_mix.repeat(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents written to a folder for each shard, and read from there with slot and shard.

    Rows with null ids share a shard, repeated ids go together, an empty table gives an empty result, and columns
    named slot or shard are replaced.
    """
    placed, path = shard_table.place(docs), noted(scratch_dir(spark))
    shard_table.write_shards(placed, path)
    return spark.read.schema(placed.schema).parquet(path).select(*[f"`{c}`" for c in placed.columns])


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources", mixed),
    ("sharding", sharded),
]

#: Near duplicates need fingerprints and connected components, which SQL does not express; the stages are
#: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage leaves, and the documents that it read, go once its result is written."""
    docs, read = table(spark, sf_dir, "documents"), []
    for at, (_, stage) in enumerate(STAGES):
        with scratch() as left:
            out = stage(spark, docs, sf_dir)
        if at == len(STAGES) - 1:
            discard(spark, read)  # the shards are files of their own
            for path in left:
                noted(path)
            return out
        with scratch() as now:
            docs = written(out)
        discard(spark, left + read)
        read = now
