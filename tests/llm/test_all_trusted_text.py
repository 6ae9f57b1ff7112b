"""The model of op6 is made of all trusted text, in groups, and gives what the model that is sent whole gives."""

import random

import pytest

from allelica.llm import perplexity_filter


def corpus(spark, n):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 40))) + f" own{k} own{k % 9}", rng.choice(["en", None])) for k in range(n)]
    rows += [(None, "w1 w2 never seen", "de"), (n, None, "en"), (n + 1, "", "en"), (1, "w1 w2 w3", "en")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


@pytest.mark.parametrize("filter_bits", [27, 10])
def test_groups_give_what_the_whole_model_gives(spark, monkeypatch, filter_bits):
    for name, value in {"GROUP": 300, "CHUNK": 700, "COMMON": 20, "FILTER_BITS": filter_bits}.items():
        monkeypatch.setattr(perplexity_filter, name, value)
    docs = corpus(spark, 120)
    training = docs.where("doc_id % 3 = 0 and text is not null").select("doc_id", "text")
    grams, unseen, _ = perplexity_filter.model(training)
    key = lambda r: (str(r[0]), str(r[1]), r[2], round(r[3], 3))
    want = sorted(map(tuple, perplexity_filter.perplexities(docs, grams, unseen).collect()), key=key)
    got = sorted(map(tuple, perplexity_filter.scores(docs.repartition(3), training).collect()), key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want] and len(got) == 124
    assert [x for r in got for x in r[3:]] == pytest.approx([x for r in want for x in r[3:]], rel=1e-4)


def test_no_trusted_text_is_left_out(spark):
    n = 4_400  # a fifth is held out; the bounded sample of before took 1,500,000 words
    docs = spark.range(n).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 440), k -> concat('v', cast(xxhash64(id, k) % 300 as string)))) as text", "'en' as lang")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    training, held = perplexity_filter.trusted_sample(docs, labels)
    assert training.count() + held.count() == n and training.count() > 3_400
