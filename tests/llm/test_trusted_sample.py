"""A long trusted text takes its share of the training words and no other text's place."""

from allelica.llm import perplexity_filter


def test_a_long_text_does_not_cut_those_after_it(spark):
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(50))) for k in range(60)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain, _ = perplexity_filter.trusted_sample(docs, labels)
    first = plain.selectExpr("doc_id", "md5(cast(concat('trust:', doc_id) as binary)) d").orderBy("d").first().doc_id
    long = [(k, " ".join(f"long{i % 900}" for i in range(5_000)) if k == first else t) for k, t in rows]
    got, _ = perplexity_filter.trusted_sample(spark.createDataFrame(long, "doc_id bigint, text string"), labels, max_words=4_000)
    words = sum(len(r.text.split()) for r in got.collect())
    assert 0 < words <= 4_000 and got.where("text like 'long%'").count() == 1
    # With room for all, every word of every text is there.
    whole, _ = perplexity_filter.trusted_sample(spark.createDataFrame(long, "doc_id bigint, text string"), labels)
    assert whole.count() == plain.count() and max(len(r.text.split()) for r in whole.collect()) == 5_000


def test_passages_of_a_long_text_lie_between_the_others(spark, monkeypatch):
    monkeypatch.setattr(perplexity_filter, "PASSAGE", 100, raising=False)
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(50))) for k in range(60)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain, _ = perplexity_filter.trusted_sample(docs, labels)
    first = plain.selectExpr("doc_id", "md5(cast(concat('trust:', doc_id) as binary)) d").orderBy("d").first().doc_id
    long = [(k, " ".join(["long"] * 5_000) if k == first else t) for k, t in rows]
    got, _ = perplexity_filter.trusted_sample(spark.createDataFrame(long, "doc_id bigint, text string"), labels, max_words=4_000)
    assert got.where(f"doc_id <> {first}").count() > 10 and got.where(f"doc_id = {first}").count() > 10
