"""Rows with null or repeated ids go through the first two stages of the pipeline each by itself."""

from allelica.llm import quality_rules, simhash_dedup
from tests.llm.conftest import SCHEMA

own = lambda k: " ".join(f"word{k}x{i}" for i in range(60))


def test_a_bad_row_takes_no_other_of_its_id(spark):
    rows = [(None, own(1), "en", "a", 1), (None, "too short", "en", "a", 1), (None, own(2), "en", "a", 1), (5, own(3), "en", "a", 1), (5, "short", "en", "a", 1)]
    got = sorted(r.text for r in quality_rules.clean(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([own(1), own(2), own(3)])


def test_a_depleted_row_takes_no_other_of_its_id(spark):
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))  # noqa: E731  digits don't count in lines
    line = "the same long line of many words stands in far too many texts of this host and says nothing new to any reader"
    rows = [(k, f"{own(name(k))}\n{line}", "en", "h", 1) for k in range(30)] + [(None, f"{line}\nx", "en", "h", 1), (None, own("z"), "en", "h", 1)]
    got = quality_rules.clean(spark.createDataFrame(rows, SCHEMA)).where("doc_id is null").collect()
    assert [r.text for r in got] == [own("z")]


def test_one_row_of_each_component_whatever_the_ids(spark):
    texts = [own(k) for k in range(4)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[2]), (7, texts[3]), (3, texts[3]), (None, texts[3])]
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in simhash_dedup.keep_one(df).collect()]
    assert sorted(got, key=str) == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (3, texts[3])], key=str)
