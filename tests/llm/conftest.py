"""Small documents with every awkward case, and the operators over them."""

import pytest

LONG = " ".join(f"w{k % 977}" for k in range(30_000))
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards mix a quiet potion for the king of the hill and his friends"
DOCS = [
    (1, PROSE, "en", "a", 5),
    (2, PROSE, "en", "a", 5),
    (2, PROSE, "en", "a", 5),  # a repeated row
    (3, PROSE.replace("lazy", "idle"), "en", None, 5),
    (4, "", "en", "b", 0),
    (5, None, None, "b", None),
    (None, "nobody knows this id", "de", "b", 3),
    (6, LONG, "fr", "c", 7),
    (7, " \n\t \r\n", "fr", "c", 7),
    (8, "one", "de", "d", 3),
    (9, "Été Ünïcode ß 日本語 🎉 <|endoftext|> a  b\n\nx", "de", "d", 3),
    (10, "Licensed under the Apache License, Version 2.0.\nThis work is licensed under CC BY-NC 4.0.", "en", "d", 3),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for columns of their own.
CLASH = ("n", "words", "size", "digits", "fp", "cell", "slot", "shard", "copy", "row", "ids", "v", "rows", "hits", "_row_key", "_mix_digits", "_slot_", "key", "salt", "hash", "host", "line", "lines", "removed")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
