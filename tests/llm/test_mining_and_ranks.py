"""Hard negatives, collocations and the rank codec against plain versions, and their awkward cases."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from allelica.llm import collocations, hard_negatives, queries, rank_bpe
from tests.conftest import SF
from tests.llm.conftest import DOCS

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# Hard negatives


def plain_negatives(rows, k=5, low=80):
    """(anchor, positive, rank, negative, score, score) of rows (id, vector of floats, label), anchors with id % 100 = 0."""
    use = [(r[0], [int(np.floor(256 * float(x))) for x in r[1]], r[2]) for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    out = []
    for i, (a, v, label) in enumerate(use):
        if a % 100:
            continue
        score = [sum(x * y for x, y in zip(v, w, strict=False)) for _, w, _ in use]
        first = lambda at: sorted(at, key=lambda j: (-score[j], use[j][0], j))[:k]  # noqa: E731, B023
        for p in first([j for j in range(len(use)) if j != i and use[j][2] == label]):
            within = [j for j in range(len(use)) if use[j][2] != label and low * score[p] <= 100 * score[j] <= 100 * score[p]]
            out += [(a, use[p][0], rank, use[j][0], score[p], score[j]) for rank, j in enumerate(first(within), 1)]
    return Counter(out)


SCHEMA = "vec_id bigint, embedding array<float>, label int"


def found(df, **more):
    return Counter(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **more).collect())


def vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    return [(int(k * 10), [float(x) for x in rng.normal(0, 0.3, dims)], int(rng.integers(0, 3))) for k in range(n)]


@pytest.mark.parametrize("cells", [1, 7, 256])
def test_negatives_at_every_cell_size(spark, cells):
    rows = vectors(150, 6, cells)
    want = plain_negatives(rows)
    assert len(want) > 50 and found(spark.createDataFrame(rows, SCHEMA).repartition(3), cells=cells, tile=40) == want


def test_negatives_with_ties_nulls_and_repeats(spark):
    rows = vectors(40, 3, 1) + [(100, [0.5, 0.5, 0.5], 1), (5, [0.5, 0.5, 0.5], 1), (7, [0.5, 0.5, 0.4], 2), (8, [0.5, 0.5, 0.4], 2), (9, [0.5, 0.5, 0.4], 2)]
    rows += [(7, [0.5, 0.5, 0.4], 2), (None, [0.5, 0.5, 0.4], 2), (300, None, 1), (301, [0.5, None, 0.5], 2), (302, [float("nan"), 1.0, 1.0], 2), (303, [float("inf"), 1.0, 1.0], 2), (304, [0.5, 0.5, 0.4], None)]
    rows += [(305, [], 2), (306, [0.9], 0), (400, [0.0, 0.0, 0.0], 1)]
    assert found(spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit(1), "tile": F.lit("x")}), tile=10) == plain_negatives(rows)


def test_no_negatives(spark):
    rows = vectors(20, 3, 2)
    assert not found(spark.createDataFrame([], SCHEMA)) and not found(spark.createDataFrame([r for r in rows if r[0] % 100], SCHEMA))
    assert not found(spark.createDataFrame([(100, [1.0], 1)], SCHEMA)) and not found(spark.createDataFrame([(100, [], 1), (200, [], 1)], SCHEMA))


def test_bounds_hold_and_cut(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-90, 90, (400, 8))
    low, high = x.min(axis=0), x.max(axis=0)
    tile = hard_negatives.Tile(low, high, 32)
    code = ((x - low) // hard_negatives.cell_widths(low, high, 32)).astype(np.uint8)
    tile.parts = [(np.arange(400), np.arange(400), np.zeros(400, dtype=np.int64), code, x.astype(np.int32))]
    tile.close()
    least, margin = tile.bounds(x[:5], slice(0, 400))
    exact = x[:5] @ x.T
    assert (least <= exact).all() and (exact <= least + margin[:, None]).all()
    assert (least[0] + margin[0] >= np.sort(least[0])[-5]).mean() < 0.2


# Collocations


def plain_phrases(docs, least, most=2000, share=100):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in regex.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = regex.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    rows = []
    for p, a in cand.items():
        cuts = [(1000 * a * n[p[0]] // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        inside = any(q[0] == p[0] and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q) - len(p) + 2)) for q, b in cand.items())
        if not inside:
            rows.append((p[0], score, a, " ".join(p[1:]), f[p[: k + 1]], f[(p[0], *p[k + 1 :])], n[p[0]]))
    out = set()
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[1], -r[2], r[3].encode()))[:most]
        out |= {(lang, i, r[3], r[2], r[4], r[5], r[6], r[1]) for i, r in enumerate(own, 1)}
    return out


def some_texts(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "a", "Quiet", "potion", "é", "日本", "KING", "x", "xy", "nine"]
    texts = [" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(40))) for _ in range(n)]
    marks = [t.replace("nine", rng.choice([",", ".\n", " \t ", "!? a"])) for t in texts]
    return [(t, rng.choice(["en", "de", None, "und"])) for t in marks] + [(None, "en"), ("", "en"), ("the the the the the the", None), ("of a king of a king " * 9, "zz")] * 2


def mined(spark, rows, least, **more):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    return {tuple(r) for r in collocations.collocations(df, least=least, **more).collect()}


@pytest.mark.parametrize("more", [{}, {"head": 3}, {"head": 0}, {"salt_rows": 5, "salt_share": 0.01}, {"group": 1}, {"group": 7, "salt_rows": 40, "salt_share": 0.0, "head": 4}], ids=str)
def test_phrases(spark, more):
    rows = some_texts(4)
    want = plain_phrases(rows, 4)
    assert len(want) > 40 and mined(spark, rows, 4, **more) == want


def test_phrases_kept_by_share_and_cut_by_rank(spark):
    rows = some_texts(5)
    assert mined(spark, rows, 3, share=150, most=7) == plain_phrases(rows, 3, 7, 150)


def test_no_phrases(spark, empty, docs):
    assert collocations.collocations(empty).count() == 0 and collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.withColumns({"word": F.lit(1), "f": F.lit(2), "n": F.lit(3)}), least=2).count() == collocations.collocations(docs, least=2).count() > 0


def test_scores_beyond_64_bits(spark):
    found = spark.createDataFrame([([1, 2], 3 * 10**9, "en", "a b", [4 * 10**12, 5 * 10**12])], "phrase array<int>, a bigint, lang string, text string, f array<bigint>")
    totals = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n bigint")
    assert collocations.scored(found, totals).first().score == 1000 * 3 * 10**9 * 9 * 10**15 // (4 * 10**12 * 5 * 10**12)


def test_equal_hashes_are_told_apart(monkeypatch):
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (500, 4)).astype(np.int32)
    got = collocations.distinct(rows, np.ones(500, dtype=np.int64))
    assert Counter(map(tuple, rows)) == {tuple(r): n for r, n in zip(*got, strict=True)}
    monkeypatch.setattr(collocations, "mixed", lambda rows: (rows[:, 0] % 2).astype(np.uint64))
    got = collocations.distinct(rows, np.ones(500, dtype=np.int64))
    assert Counter(map(tuple, rows)) == {tuple(r): n for r, n in zip(*got, strict=True)}


# Rank codec


@pytest.fixture(scope="module")
def encoding():
    return rank_bpe._encoding(open(RANKS, "rb").read(), rank_bpe.SPLIT)


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}


def plain_ids(text, ranks):
    """Merges of the lowest rank first, match by match."""
    out = []
    for m in regex.findall(public_tokenizers.PATTERN, text):
        parts = [bytes([b]) for b in m.encode()]
        while True:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30), default=None)
            if at is None or parts[at] + parts[at + 1] not in ranks:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out += [ranks[p] for p in parts]
    return out


def test_digests_of_plain_merges(spark, ranks):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_rank_bpe(spark, SF).collect()}
    rows = docs.collect()
    assert set(got) == {r.doc_id for r in rows}
    for r in rows[::4]:
        ids, one = plain_ids(r.text or "", ranks), got[r.doc_id]
        assert (one.n_tokens, one.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
    assert all(got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in rows)


def test_pieces_change_nothing(encoding, ranks):
    rng = random.Random(2)
    letters = "ab Z9 .,'s'll\n\t  。日本éß　\xa0\x85\x1c!?)"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        ids = rank_bpe.encode_text(encoding, text, True, 5, 3)
        assert np.frombuffer(ids, dtype="<u4").tolist() == encoding.encode_ordinary(text) == plain_ids(text, ranks)
        assert rank_bpe.decode_ids(encoding, ids, 7) == text.encode()


def test_long_runs(encoding):
    for text in ("a " + " " * 1_500_000 + "b", "x" * 300_000, "日本。" * 100_000, "\n" * 60_000, "word " * 200_000):
        parts = list(rank_bpe.pieces(text))
        assert "".join(p for p, _ in parts) == text
        assert rank_bpe.decode_ids(encoding, rank_bpe.encode_text(encoding, text, True)) == text.encode()
    assert max(len(p) for p, _ in rank_bpe.pieces("word " * 200_000)) <= rank_bpe.PIECE
    assert max(len(p) for p, _ in rank_bpe.pieces("日本。" * 100_000)) <= rank_bpe.PIECE


def test_awkward_rows(spark, docs, clashing, empty):
    plain = rank_bpe.round_trip(docs, RANKS)
    assert Counter(r.doc_id for r in plain.collect()) == Counter(d[0] for d in DOCS)
    assert all((r.n_tokens == 0) == (r.decoded_sha256 == hashlib.sha256(b"").hexdigest()) for r in plain.collect())
    assert rank_bpe.round_trip(clashing, RANKS).exceptAll(plain).count() == 0 == rank_bpe.round_trip(empty, RANKS).count()
    odd = spark.sql("select 1L as doc_id, cast(unhex('61FF62') as string) as text")
    assert rank_bpe.round_trip(odd, RANKS).first().decoded_sha256 == hashlib.sha256("a�b".encode()).hexdigest()


def test_other_patterns_are_not_cut(spark):
    codec = rank_bpe.Codec(spark, RANKS, r"[\s\S]{1,4}")
    df = spark.createDataFrame([("a b " * 30_000,)], "text string").withColumn("ids", codec.encode("text"))
    assert df.select(codec.decode("ids").alias("raw")).first().raw == b"a b " * 30_000
