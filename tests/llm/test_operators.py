"""The operators against brute force, round trips and held-out text."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from allelica.llm import components, decontaminate, html_extract, license_scan, mixing_lm, perplexity_filter, quality_rules, shard_table, simhash_dedup, source_mix, token_codec
from tests.conftest import SF

WORD, PLAIN = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(corpus):
    return {r.doc_id: r.text for r in corpus.collect()}


def test_lines_above_the_limit_go(spark):
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))  # noqa: E731  digits don't count in lines
    fill = lambda k: " ".join(f"own{name(k)}x{name(i)}" for i in range(30))
    rows = [(k, f"{fill(k)}\nShared  LINE of {k}!", "h") for k in range(30)]
    rows += [(100 + k, "shared line of 7\n" * 12, "h") for k in range(3)]
    rows += [(200, "shared line of 9 " + fill(200), "other")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert all(got[k].n_removed == 1 and got[k].kept for k in range(30))
    assert all(got[100 + k].depleted and not got[100 + k].kept for k in range(3))
    assert got[200].n_removed == 0
    assert {r.text for r in quality_rules.clean(df.where("doc_id = 3 or doc_id <> 3")).where("doc_id < 2").collect()} == {fill(0), fill(1)}


def fingerprint(text):
    words = re.findall(WORD, low(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    parent = {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in prints}


def test_simhash_matches_all_pairs(corpus, texts, spark):
    prints = {k: fingerprint(t) for k, t in texts.items()}
    want = classes(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.cluster(corpus).collect()}
    assert got == {k: (f"{f:016x}", want[k]) for k, f in prints.items()}
    kept = sorted(r.doc_id for r in simhash_dedup.keep_one(corpus).collect())
    assert kept == sorted(set(want.values()))


def test_links_of_chained_fingerprints(spark):
    rng = random.Random(3)
    prints = {0, (1 << 64) - 1}
    for _ in range(15):
        x = rng.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            for _ in range(rng.choice([1, 2, 3])):
                x ^= 1 << rng.randrange(64)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in prints}
    links = simhash_dedup.links(spark.createDataFrame([(s,) for s in signed], "fp bigint"))
    got = {r.node: r.root for r in components.components(links).collect()}
    assert {s: got.get(s, s) for s in signed} == classes(signed)


def test_component_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)], "a bigint, b bigint")
    assert {r.root for r in components.components(edges).collect()} == {0}


def test_license_templates():
    s = license_scan.Scanner()
    names = lambda t: {x[2] for x in s.scan(t.encode())["accepted"]}
    assert names("This work is licensed under the GNU General Public License, version 3.") == {"gpl-3.0"}
    assert names("This odd little work is licensed under the GNU General Public License, version 3") == {"gpl-3.0"}
    assert names("licensed under the GNU Public License, version 3") == set()
    assert names("Released under the terms of a CC BY 4.0") == set()
    assert names("licensed under the terms of a CC BY 4.0") == {"cc-by-4.0"}
    a = license_scan.compile_template("a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> <<var:1-2>> d")
    for text, end in (("a x d", 3), ("a b x d", 4), ("a b c x y d", 6), ("a d", -1), ("a x y z d", -1), ("a b d d", 4)):
        assert a.longest(text.encode().split(), 0) == end
    with pytest.raises(ValueError):
        license_scan.compile_template("<<beginOptional>>a<<endOptional>>")


def test_license_base(corpus, texts):
    got = {r.doc_id: r for r in license_scan.scan(corpus).collect()}
    for k, t in texts.items():
        words = re.findall(PLAIN, low(t))
        at = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (got[k].n_words, got[k].n_base) == (len(words), len(at))
        assert (got[k].first_word, got[k].last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert got[k].base_labels == ",".join(sorted({x for _, x in at}))


def test_mix_targets(spark):
    rng = random.Random(1)
    rows = [(k, "w " * rng.randint(1, 60), rng.choice("aaaaaabcd") if k % 50 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = source_mix.mix(df).toPandas()
    per = got.groupby("source", dropna=False).agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per.own).all() and per.target.sum() == pytest.approx(1.5 * per.own.sum())
    assert ((per.taken - per.target).abs() <= 60).all()
    assert (got.taken <= 2 * got["size"]).all()
    again = source_mix.mix(df.repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))
    copies = Counter(r.doc_id for r in source_mix.repeat(df).collect())
    assert {k: v for k, v in zip(got.doc_id, got.passes) if v} == dict(copies)


def test_repeated_rows_are_taken_in_part(spark):
    rows = [(1, "w " * 10, "a")] * 900 + [(None, f"w{k} " * 10, "a") for k in range(100)] + [(k, "x " * 10, "b") for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = source_mix.mix(df).toPandas()
    per = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((per.taken - per.target).abs() <= 10).all()
    again = source_mix.mix(df.repartition(6)).toPandas()
    key = lambda d: sorted(zip(d.doc_id.fillna(-1), d.taken))
    assert key(got) == key(again) and source_mix.repeat(df).count() == got.passes.sum()


def test_decontamination_in_blocks_and_shards(spark, corpus):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = lambda **k: sorted(map(tuple, decontaminate.report(corpus, bench, **k).collect()), key=str)
    assert rows() == rows(block_bytes=9000, shard_words=3000)
    clean = {r.doc_id for r in decontaminate.remove(corpus, bench).collect()}
    assert clean == {r.doc_id for r in decontaminate.report(corpus, bench).where("not contaminated").collect()}


def longest_by_loops(docs, items, window=10):
    """(words, first word, least item) of the longest run of each document in an item that holds a window."""
    out = []
    for words in docs:
        best = (0, 0, "")
        for name, own in items:
            size = min(window, len(own))
            for i in range(len(words)):
                for j in range(len(own) - size + 1):
                    n = 0
                    while i + n < len(words) and j + n < len(own) and words[i + n] == own[j + n]:
                        n += 1
                    if size and n >= size:
                        best = min(best, (-n, i, name))
        out.append((-best[0], best[1], best[2]) if best[0] else (0, None, None))
    return out


def test_longest_matches_whatever_the_shards(spark):
    rng = random.Random(5)
    items = [(f"i{k}", [rng.choice("abc") for _ in range(n)]) for k, n in enumerate((30, 30, 15, 4, 12, 10, 1))]
    items[1] = ("i1", items[0][1][5:] + list("xyzab"))
    items[6] = ("i6", ["lonely"])
    cut = lambda own: own[(a := rng.randrange(len(own))) : a + rng.randint(1, 25)]
    docs = [[w for _ in range(4) for w in [*cut(rng.choice(items)[1]), *(["q"] * rng.randint(0, 2))]] for _ in range(60)]
    docs += [items[0][1][:12], items[0][1][:15], items[0][1], [], ["lonely"]]
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id int, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id string, text string")
    want = longest_by_loops(docs, items)
    for sizes in ({}, {"block_bytes": 40}, {"shard_words": 30}, {"block_bytes": 70, "shard_words": 100}):
        got = {r.doc_id: (r.longest, r.longest_start, r.longest_item) for r in decontaminate.report(df, bench, **sizes).collect()}
        assert [got[k] for k in range(len(docs))] == want


def test_shard_lookup():
    rng = np.random.default_rng(0)
    keys = rng.integers(1, 1 << 62, 5000).astype(np.uint64) | np.uint64(1)
    values = rng.random(5000).astype(np.float32)
    s = perplexity_filter.Shard(keys, values)
    assert np.array_equal(s.get(keys, 0.0), values)
    assert (s.get(keys ^ np.uint64(2), -1.0) == -1).mean() > 0.99


def test_kneser_ney_distribution(spark):
    text = "a b a c a b d a b a a c b"
    grams, unseen, types = perplexity_filter.model(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    tables = [perplexity_filter.Shard(k, v) for k, v in perplexity_filter.shards(grams)]
    h = perplexity_filter.Hasher()
    words = np.append(h.text(b"a b c d unseen".split()), perplexity_filter.END)
    assert types == 5
    for context in (b"a b", b"b d", b"q q", b"c q"):
        u, v = h.text(context.split())
        p = 10 ** perplexity_filter.log_probs(np.full(6, u), np.full(6, v), words, tables, unseen)
        assert p.sum() == pytest.approx(1, abs=1e-5)


def kneser_ney(text):
    """Probability of a word after two others, from counts in dictionaries."""
    words = ["<", "<", *text.split(), ">"]
    tri = Counter(zip(words, words[1:], words[2:], strict=False))
    bi, uni = Counter((v, w) for _, v, w in tri), None
    uni = Counter(w for _, w in bi)

    def discount(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        if not all(n):
            return lambda c: [0.5, 1.0, 1.5][min(c, 3) - 1]
        y = n[0] / (n[0] + 2 * n[1])
        d = [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 0.95) for k in range(3)]
        return lambda c: d[min(c, 3) - 1]

    d3, d2, d1 = discount(tri), discount(bi), discount(uni)
    total = sum(uni.values())
    floor = sum(map(d1, uni.values())) / total / (len(uni) + 1)

    def p(u, v, w):
        q = (uni[w] - d1(uni[w])) / total + floor if w in uni else floor
        for counts, d, left in ((bi, d2, (v,)), (tri, d3, (u, v))):
            own = {k: c for k, c in counts.items() if k[:-1] == left}
            if own:
                n, seen = sum(own.values()), own.get((*left, w), 0)
                q = (seen - d(seen) if seen else 0) / n + sum(map(d, own.values())) / n * q
        return q

    return p


def test_perplexities_match_dictionaries(spark):
    rng = random.Random(9)
    text = " ".join(rng.choice("aaaabbbccd") + rng.choice("xy") for _ in range(400))
    grams, unseen, _ = perplexity_filter.model(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    p = kneser_ney(text)
    docs = ["ax by ax", "cy cy cy dx never ax", "", "dy"]
    df = spark.createDataFrame([(k, "en", t) for k, t in enumerate(docs)], "doc_id bigint, lang string, text string")
    for r in perplexity_filter.perplexities(df, grams, unseen).collect():
        words = ["<", "<", *docs[r.doc_id].split(), ">"]
        want = sum(np.log10(p(*g)) for g in zip(words, words[1:], words[2:], strict=False))
        assert r.log10_prob == pytest.approx(want, rel=1e-4)


def test_without_training_text_all_rows_with_words_stay(spark, corpus):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = perplexity_filter.classify(corpus, labels).toPandas()
    assert (got.kept == (got.n_words > 0)).all() and got.threshold.isna().all()


def test_classifier_parts_junk_from_prose(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    prose = lambda: " ".join(rng.choice(vocabulary) for _ in range(80))
    rows = [(k, prose(), "en") for k in range(200)] + [(1000 + k, " ".join(f"z{rng.random()}" for _ in range(80)), "en") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(150)], "doc_id bigint, quality int, toxic int")
    got = perplexity_filter.classify(df, labels).toPandas()
    assert got[got.doc_id < 1000].kept.mean() > 0.95 and not got[got.doc_id >= 1000].kept.any()


def test_extraction_skips_what_is_no_article():
    page = (
        "<html><head><title>t</title><script>var a='</p>';</script></head><body><header>Site</header><div class='cookie-notice'>We use cookies, fine.</div>"
        "<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Title &amp; more</h1><p>First,\n second.<br>Third.<p>Fourth <b>bold</b> end."
        "<div class='ad'>Buy now, cheap!</div><aside>See also</aside></article><section id=comments><p>Nice, thanks!</p></section>"
        "<form><input><button>Go</button></form><footer>&copy; me</footer></body></html>"
    )
    assert html_extract.main_text(page) == "Title & more\nFirst, second. Third.\nFourth bold end."
    other = page.replace("<article>", "<div id=content>").replace("</article>", "</div>")
    assert html_extract.main_text(other) == html_extract.main_text(page)


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (re.sub(r"\s+", " ", html_extract.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b)))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_all_articles_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows)).collect()}
    assert got == {r.page_id: article(r.html) for r in rows}


def blind(page):
    """The page without names that tell what a box is: every box is a div."""
    return re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", page).replace(' class="ad"', "")


def test_ratios_decide_where_no_name_does(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]

    def share():
        exact, found, whole, given = 0, 0, 0, 0
        for p in pages:
            want, got = article(p).split("\n"), html_extract.main_text(blind(p)).split("\n")
            exact += want == got
            found += sum(map(len, set(want) & set(got)))
            whole, given = whole + sum(map(len, set(want))), given + sum(map(len, set(got)))
        return exact / len(pages), found / whole, found / given

    exact, recall, precision = share()
    assert exact > 0.9 and recall > 0.99 and precision > 0.99
    monkeypatch.setattr(html_extract, "ratios", lambda page: ([1.0] * len(page.paths), set()))
    assert share()[0] < 0.2


def test_ratios_match_a_table_of_paths():
    page = "<body><div><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul></div><div><h1>Head</h1><p>Some, text. More!<p>And <b>bold</b>.</div></body>"
    table = {
        "body>div>ul>li": (3, "One" + "Two" + "Three", 0, 11), "body>div>h1": (1, "Head", 0, 0), "body>div>p": (2, "Some, text. More!And bold.", 4, 0),
    }
    own = html_extract.Page(page)
    fused, lists = html_extract.ratios(own)

    def path(k):
        return f"{path(own.paths[k][0])}>{own.paths[k][1]}" if own.paths[k][0] > 0 else own.paths[k][1]

    got = {path(k): fused[k] for k in {b[1] for b in own.blocks}}
    want = {k: len(text) / n * (1 + marks / n) * (1 - links / len(text)) for k, (n, text, marks, links) in table.items()}
    assert got == pytest.approx(want) and {path(k) for k, _ in lists} == {"body>div>ul>li"}


def test_what_stays_and_goes_in_an_article():
    inner = '<p class="related-work">Related work, in prose.</p><p>See <math><mi>x</mi></math> and <object>this</object>.</p><ul><li>Item<li>Item, two</ul>'
    menu = "<ul><li><a>A</a><li><a>B</a><li><a>C</a></ul>"
    page = f"<body><article><header><h1><a>Title</a></h1></header><div><p>Long enough, said he, to be prose. Yes!</p>{inner}</div><div>{menu}</div><div class='site-footer'>x</div></article></body>"
    assert html_extract.main_text(page) == "Title\nLong enough, said he, to be prose. Yes!\nRelated work, in prose.\nSee x and this.\nItem\nItem, two"


def test_scores_of_the_base_model_and_held_out_text(corpus, texts):
    words = {k: [*re.findall(WORD, low(t)), None] for k, t in texts.items()}
    counts = Counter(w for k, ws in words.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = mixing_lm.score(corpus).toPandas().set_index("doc_id")
    for k, ws in words.items():
        r = got.loc[k]
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), n, zlib.crc32(str(k).encode()) % 7 == 2)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def mixed_by_loops(texts, training, tokens, counts):
    """The mixture of one block, one bit after another, with dictionaries for tables and state."""
    m = mixing_lm
    sigmoid = lambda z: 1 / (1 + np.exp(-z))

    def table(words, orders, ends):
        seen = {}
        for word, n in words.items():
            for i in range(len(word) + 1):
                for byte, weight in [(word[i], n)] if i < len(word) else [(32, n * (1 - ends)), (10, n * ends)]:
                    for order in orders:
                        for k in range(8):
                            key = (order, word[:i] if order is None else (word[max(0, i - order) : i], i <= order), byte >> (8 - k), k)
                            seen.setdefault(key, [0, 0])[byte >> (7 - k) & 1] += weight
        return lambda key: np.clip(np.rint(np.log((seen[key][1] + m.PRIOR) / (seen[key][0] + m.PRIOR)) * 16), -127, 127) / 16 if key in seen else 0.0

    total = dict(zip(tokens, counts, strict=True))
    n_ends = total.pop(b"", 0)
    corpus = table(total, [2, 4, None], n_ends / sum(total.values()))
    own = Counter(w for t, learn in zip(texts, training, strict=True) if learn for w in t[:-1].split())
    local = table(own, [None], sum(training) / sum(own.values()))

    def backs(text, at):
        begin = max(text.rfind(b" ", 0, at) + 1, 0)
        for back in (0, 1, 2):
            yield begin, text[begin:at]
            begin = text.rfind(b" ", 0, begin - 1) + 1 if begin else 0

    after = {}
    for t, learn in zip(texts, training, strict=True):
        for i in range(len(t)):
            for back, (begin, c) in enumerate(backs(t, i)):
                if back and learn:
                    after.setdefault((back, c), Counter())[t[i]] += 1

    def follow(back, c):
        if (back, c) not in after:
            return 0, 0
        found = after[back, c]
        most = max(found.values())
        share, byte = most / sum(found.values()), min(b for b, n in found.items() if n == most)
        return byte, sum(most >= x for x in (1, 2, 3, 5)) if share == 1 else 5 + sum(share >= x for x in (0.5, 0.7, 0.9))

    out = []
    for t in texts:
        logp = 0.0
        for at in range(len(t)):
            if at % m.PASSAGE == 0:
                weights, trust, fixes = {}, {}, {}
            (_, word), *longer = backs(t, at)
            guess = [follow(k + 1, c) for k, (_, c) in enumerate(longer)]
            gate = tuple(m.GRADE[level] for _, level in guess)
            w = weights.setdefault(gate, np.array(m.START))
            r = [trust.get((k, level), m.TRUST[level]) for k, (_, level) in enumerate(guess)]
            alive = [level > 0 for _, level in guess]
            for k in range(8):
                bit = t[at] >> (7 - k) & 1
                node = (t[at] >> (8 - k), k)
                x = [corpus((o, word if o is None else (word[max(0, len(word) - o) :], len(word) <= o), *node)) for o in (2, 4, None)]
                x.append(local((None, word, *node)))
                want = [byte >> (7 - k) & 1 for byte, _ in guess]
                x = np.array(x + [(2 * want[j] - 1) * r[j] if alive[j] else 0.0 for j in (0, 1)])
                p = sigmoid(np.clip(w @ x + fixes.get(k, 0.0), -9, 9))
                w += m.RATE * (bit - p) * x
                fixes[k] = fixes.get(k, 0.0) + m.REFINE * (bit - p)
                logp += np.log10(p if bit else 1 - p)
                alive = [a and v == bit for a, v in zip(alive, want, strict=True)]
            for j, (_, level) in enumerate(guess):
                if level:
                    trust[j, level] = r[j] + m.ADAPT * (alive[j] - sigmoid(r[j]) ** 8)
        out.append(logp)
    return out


def block_and_table(monkeypatch):
    monkeypatch.setattr(mixing_lm, "PASSAGE", 40)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(30)] + ["é"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 25))).encode() + b"\n" for _ in range(12)] + [b"\n", b"zz unseen \xff\n"]
    texts.append(texts[0])
    training = np.array([k % 4 != 1 for k in range(len(texts))])
    counts = Counter(w.encode() for w in words for _ in range(rng.randint(1, 40)))
    counts[b""] = 50
    return texts, training, list(counts), list(counts.values())


def test_mixture_matches_plain_loops(monkeypatch):
    texts, training, tokens, counts = block_and_table(monkeypatch)
    got = mixing_lm.block_scores(texts, training, mixing_lm.corpus_table(tokens, counts))
    assert got == pytest.approx(mixed_by_loops(texts, training.tolist(), tokens, counts), rel=1e-4)


def test_probabilities_of_all_next_bytes_sum_to_one(monkeypatch):
    texts, training, tokens, counts = block_and_table(monkeypatch)
    corpus = mixing_lm.corpus_table(tokens, counts)
    many = [*texts, *[texts[0][:-1] + bytes([b]) for b in range(256)], texts[0][:-1]]
    more = np.concatenate([training, np.zeros(257, dtype=bool)])
    logs = mixing_lm.block_scores(many, more, corpus)
    assert (10.0 ** (logs[-257:-1] - logs[-1])).sum() == pytest.approx(1, rel=1e-3)


def test_blocks_do_not_depend_on_the_layout(spark, corpus):
    one = {r.doc_id: r.score for r in mixing_lm.score(corpus).collect()}
    assert {r.doc_id: r.score for r in mixing_lm.score(corpus.repartition(5)).collect()} == one
    small = mixing_lm.score(corpus, block_bytes=30_000).toPandas()
    assert len(small) == len(one) and (small.score < 0).all()


@pytest.mark.parametrize("limit", [4, 5, 16])
def test_code_lengths(limit):
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    lengths = token_codec.code_lengths(counts, limit).astype(int)
    assert lengths.max() <= limit and (0.5**lengths).sum() <= 1
    if limit == 16:
        assert (lengths * counts).sum() == 1 * 9 + 1 * 9 + 2 * 8 + 3 * 7 + 5 * 6 + 8 * 5 + 13 * 4 + 21 * 3 + 34 * 2 + 55


def test_code_round_trip():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 200_000), 3000)
    seen, n = np.unique(ids, return_counts=True)
    code = token_codec.Code(seen, token_codec.code_lengths(n))
    parts = np.split(ids, [1, 70_000, 140_001])
    packed = [code.pack(p) for p in parts]
    back = code.unpack([p for p, _ in packed], [o for _, o in packed], [len(p) for p in parts])
    assert all(np.array_equal(a, b) for a, b in zip(parts, back, strict=True))
    single = token_codec.Code(np.array([7]), token_codec.code_lengths(np.array([3])))
    assert single.unpack(*[[x] for x in single.pack(np.array([7, 7, 7]))], [3])[0].tolist() == [7, 7, 7]


def test_more_ids_than_the_shortest_limit_holds():
    counts = np.concatenate([np.full(70_000, 3), [10**6]])
    lengths = token_codec.code_lengths(counts, len(counts).bit_length())
    code = token_codec.Code(np.arange(len(counts)), lengths)
    ids = np.concatenate([np.arange(0, 70_001, 7), [70_000] * 50])
    payload, offsets = code.pack(ids)
    assert code.limit == lengths.max() == 17 and code.unpack([payload], [offsets], [len(ids)])[0].tolist() == ids.tolist()


def test_encoder_matches_the_library(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, own = Tokenizer.from_file(path), token_codec.Encoder(path)
    odd = ["", " ", "a ", " a", "a  b", "x\ny", "x \ny", "x\n\ny", "don't 's 't", "<|endoftext|>", "a <|endoftext|>.", "é b　c", "1,234.5 (x)!", "a\x1cb", "﻿a b", "a.b c's, d!! e...\nF"]
    many = [*odd, *texts.values()]
    for t, ids in zip(many, own.encode(many, 2), strict=True):
        assert np.frombuffer(ids, dtype=own.width).tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_codec_round_trip(corpus, texts, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_codec, "IDS_PER_PARTITION", 20_000)
    monkeypatch.setattr(token_codec, "BLOCK", 4096)  # documents span blocks
    tokenizer, at, want = Tokenizer.from_file(path), 0, []
    for k in sorted(texts):
        ids = [*tokenizer.encode(texts[k], add_special_tokens=False).ids, 2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_codec.round_trip(corpus, path).collect())) == want


def test_table_is_even_and_stable():
    names = [f"s{k}" for k in range(20)]
    full, less = shard_table.fill_table(names, 2003), shard_table.fill_table(names[:-1], 2003)
    assert set(np.bincount(full)) == {100, 101}
    stay = full != 19
    assert (full[stay] == less[stay]).mean() > 0.9
    for bad in (2000, 13):
        with pytest.raises(ValueError):
            shard_table.fill_table(names, bad)


def test_placement_matches_a_plain_loop(corpus, tmp_path):
    import hashlib

    table = shard_table.fill_table([f"shard-{i:05d}" for i in range(64)], 65_537)
    placed = shard_table.place(corpus)
    for r in placed.select("doc_id", "slot", "shard").collect():
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 65_537
        assert (r.slot, r.shard) == (slot, table[slot])
    shard_table.write_shards(placed, str(tmp_path / "out"))
    assert corpus.sparkSession.read.parquet(str(tmp_path / "out")).count() == corpus.count()
