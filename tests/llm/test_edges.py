"""Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables, for every operator."""

import public_tokenizers
import pytest

import corpus_pipeline
from allelica.llm import decontaminate, html_extract, license_scan, mixing_lm, perplexity_filter, quality_rules, shard_table, simhash_dedup, source_mix, token_codec
from tests.llm.conftest import DOCS

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def items(spark):
    return spark.createDataFrame([(1, "seven wizards mix a quiet potion for the king of the hill"), (2, None), (3, "..."), (None, "nobody knows")], "item_id bigint, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1), (None, 1, 0), (6, 1, None)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "op1": lambda spark, d: quality_rules.judge(d),
    "op2": lambda spark, d: simhash_dedup.cluster(d),
    "op3": lambda spark, d: license_scan.scan(d),
    "op4": lambda spark, d: source_mix.mix(d),
    "op5": lambda spark, d: decontaminate.report(d, items(spark)),
    "op6": lambda spark, d: perplexity_filter.classify(d, labels(spark)),
    "op8": lambda spark, d: mixing_lm.score(d),
    "op9": lambda spark, d: token_codec.round_trip(d, TOKENIZER),
    "op10": lambda spark, d: shard_table.place(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, docs, clashing, empty, name):
    op = OPERATORS[name]
    plain = op(spark, docs)
    rows = sorted(plain.toPandas().doc_id.fillna(-1).astype(int))
    assert rows == sorted(-1 if d[0] is None else d[0] for d in DOCS)
    assert op(spark, clashing).count() == len(DOCS)
    assert op(spark, empty).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, clashing, empty, tmp_path, k):
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    last = k == len(corpus_pipeline.STAGES) - 1
    for d in (docs, clashing, empty):
        out = stage(spark, d, str(tmp_path))
        assert out.columns[: 5] == docs.columns and (last or out.columns == d.columns)
        assert (out.count() > 0) == (d is not empty)


def test_pages(spark):
    rows = [(1, "u", "<html><body><nav>m</nav><article><h1>T</h1><p>Hi, there.</article></body>"), (None, None, None), (2, "u", ""), (2, "u", ""), (3, "u", "<p>" * 5000 + "deep"), (4, "u", "<div <<<>>> & &amp; <a")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {(r.page_id, r.text) for r in html_extract.extract(df).collect()}
    assert (1, "T\nHi, there.") in got and (None, "") in got and (3, "deep") in got
    assert html_extract.extract(df.limit(0)).count() == 0


def test_pages_with_other_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>Hi, there.</p>", "old", 3), (1, "u", "<p>Hi, there.</p>", "old", 3)], "page_id bigint, url string, html string, text string, n_chars int")
    got = html_extract.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and [(r.text, r.n_chars) for r in got.collect()] == [("Hi, there.", 10)] * 2


def test_nothing_to_find_or_to_learn_from(spark, docs, empty, tmp_path):
    none = items(spark).limit(0)
    assert all(not r.contaminated and r.longest == 0 and r.longest_item is None for r in decontaminate.report(docs, none).collect())
    assert decontaminate.remove(docs, none).count() == len(DOCS)
    got = perplexity_filter.classify(docs, labels(spark).limit(0)).toPandas()
    assert (got.kept == (got.n_words > 0)).all()
    shard_table.write_shards(shard_table.place(empty), str(tmp_path / "none"))
    assert spark.read.schema(shard_table.place(empty).schema).parquet(str(tmp_path / "none")).count() == 0
