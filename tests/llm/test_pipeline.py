"""The pipeline against its stages written plainly."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from allelica.llm import decontaminate, quality_rules, shard_table, source_mix
from allelica.llm.common import scratch
from tests.conftest import SF
from tests.llm.test_operators import classes, fingerprint


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    verdict = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    cut = {r.doc_id: r.text for r in quality_rules.clean(docs).collect()}
    texts = {r.doc_id: cut[r.doc_id] for r in docs.collect() if verdict[r.doc_id].kept}
    assert set(cut) == set(texts) and any(r.n_removed for r in verdict.values())
    prints = {k: fingerprint(t) for k, t in texts.items()}
    first = set(classes(prints).values())
    dirty = {r.doc_id for r in decontaminate.report(quality_rules.clean(docs), spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    left = sorted(first - dirty)
    passes = {r.doc_id: r.passes for r in source_mix.mix(quality_rules.clean(docs).where(F.col("doc_id").isin(left))).collect()}
    want = Counter({k: n for k, n in passes.items() if n})
    table = shard_table.fill_table([f"shard-{i:05d}" for i in range(64)], 65_537)
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == want
    assert all(r.text == texts[r.doc_id] for r in got)
    assert all(r.shard == table[int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 65_537] for r in got)


def test_frames_of_stages_stay_readable(spark):
    """Two corpora through the same and later stages, held at once; the operators' scratch tables go, theirs do not."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    evens, odds = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    a, b = corpus_pipeline.quality(spark, evens, SF), corpus_pipeline.quality(spark, odds, SF)
    c = corpus_pipeline.near_duplicates(spark, a, SF)
    d = corpus_pipeline.sharded(spark, corpus_pipeline.mixed(spark, b, SF), SF)
    assert a.count() > c.count() > 0 and d.count() > b.count() > 0
    assert {r.doc_id % 2 for r in a.collect()} == {0} and {r.doc_id % 2 for r in d.collect()} == {1}


def test_run_leaves_only_the_shards(spark):
    with scratch() as left:
        got = corpus_pipeline.run(spark, SF)
    there = [p for p in left if spark._jvm.java.io.File(p.removeprefix("file://")).exists()]
    assert len(there) == 1 and all(there[0].removeprefix("file://") in f for f in got.inputFiles())
    assert {f"shard={r.shard}" for r in got.select("shard").distinct().collect()} == {f.split("/")[-2] for f in got.inputFiles()}


def test_keys_of_files_and_of_other_rows(spark, docs):
    """Rows of files are named by file and place, and so need no copy; exploded ones are not."""
    from allelica.llm.common import ROW, keyed, read_plainly

    files = spark.read.parquet(f"{SF}/documents.parquet")
    twice = files.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    assert read_plainly(files.where("doc_id > 3").select("doc_id", "text")) and not read_plainly(twice) and not read_plainly(docs) and not read_plainly(files.union(files))
    for df in (files, twice, docs, files.union(files), files.withColumn("_metadata", F.lit(1))):
        assert keyed(df).select(ROW).distinct().count() == df.count()
