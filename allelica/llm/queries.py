"""The queries over the llm operators and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelica.llm import (
    collocations,
    decontaminate,
    hard_negatives,
    html_extract,
    license_scan,
    mixing_lm,
    perplexity_filter,
    quality_rules,
    rank_bpe,
    shard_table,
    simhash_dedup,
    source_mix,
    token_codec,
)
from allelica.llm.common import table


def op1_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark, sf_dir):
    return simhash_dedup.cluster(table(spark, sf_dir, "documents"))


def op3_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op4_source_mix(spark, sf_dir):
    return source_mix.mix(table(spark, sf_dir, "documents")).drop("source")


def op5_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_perplexity_filter(spark, sf_dir):
    return perplexity_filter.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_mixing_lm(spark, sf_dir):
    return mixing_lm.score(table(spark, sf_dir, "documents"))


def op9_token_codec(spark, sf_dir):
    import public_tokenizers

    return token_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_shard_table(spark, sf_dir):
    return shard_table.place(table(spark, sf_dir, "documents").select("doc_id"))


def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_rank_bpe(spark, sf_dir):
    import public_tokenizers

    return rank_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries():
    found = (
        op1_quality_rules, op2_simhash_dedup, op3_license_scan, op4_source_mix, op5_decontaminate, op6_perplexity_filter,
        op7_html_extract, op8_mixing_lm, op9_token_codec, op10_shard_table,
        op11_hard_negatives, op12_collocations, op13_rank_bpe,
    )
    return {f.__name__: f for f in found}


_WORDS = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = rf"""
WITH d AS (SELECT doc_id, source, COALESCE(text, '') AS text, ROW_NUMBER() OVER () AS rid FROM documents),
w AS (SELECT *, {_WORDS} AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS k FROM w, UNNEST(range(1, len(ws) - 6)) AS t(i)),
dup AS (SELECT rid, i FROM (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, SUM(LEAST(8, step)) AS n FROM (SELECT rid, i - LAG(i, 1, -8) OVER (PARTITION BY rid ORDER BY i) AS step FROM dup) GROUP BY 1),
l AS (SELECT rid, source, text, UNNEST(string_split(text, chr(10))) AS raw FROM d),
n AS (SELECT rid, source, text, length(regexp_replace(raw, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
  trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x60\x7B-\x7F]+', ' ', 'g')) AS norm FROM l),
m AS (SELECT * FROM n WHERE norm <> ''),
per AS (SELECT source, norm, COUNT(DISTINCT rid) AS nd, COUNT(DISTINCT text) AS nt FROM m GROUP BY 1, 2),
often AS (SELECT source, norm FROM (SELECT *, SUM(nd) OVER (PARTITION BY norm) AS ad, SUM(nt) OVER (PARTITION BY norm) AS tt FROM per)
  WHERE (nd > 10 AND nt > 5) OR (ad > 20 AND tt > 5)),
lost AS (SELECT rid, SUM(chars) AS total, SUM(CASE WHEN o.norm IS NOT NULL THEN chars ELSE 0 END) AS lost, COUNT(o.norm) AS n_removed
  FROM m LEFT JOIN often o ON o.source IS NOT DISTINCT FROM m.source AND o.norm = m.norm GROUP BY 1),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(COALESCE(cov.n, 0) AS BIGINT) AS n_repeat_words,
  COALESCE(n_removed, 0) AS n_removed, COALESCE(lost > 0.5 * total, FALSE) AS depleted
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN lost USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM f
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || md5(text)), 1, 9) AS digits, ROW_NUMBER() OVER () AS rid
  FROM (SELECT doc_id, source, COALESCE(text, '') AS text FROM documents)),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
p AS (SELECT *, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM s),
c AS (SELECT *, CASE pos % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS stop FROM p),
v AS (SELECT *, (SUM(source_size) OVER () * 1.5::DOUBLE - COALESCE(SUM(stop) OVER (ORDER BY stop / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / SUM(weight) OVER (ORDER BY stop / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, weight, stop, (SELECT FIRST(level ORDER BY stop / weight, pos) FROM v WHERE level * weight <= stop) AS level FROM v),
g AS (SELECT source, source_size, LEAST(COALESCE(level * weight, stop), stop) AS target FROM t),
k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(FLOOR(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
r AS (SELECT *, SUM(size) OVER (PARTITION BY source ORDER BY digits, rid ROWS UNBOUNDED PRECEDING) AS upto FROM d),
x AS (SELECT r.rid, k.*, r.doc_id, r.size, r.upto <= k.target - k.whole * k.source_size
  OR (r.upto - r.size <= k.target - k.whole * k.source_size AND (k.target - k.whole * k.source_size - (r.upto - r.size)) * 2 > r.size) AS more
  FROM r JOIN k ON r.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, CAST(size * LEAST(whole + CAST(more AS BIGINT), 2) AS BIGINT) AS taken, CAST(LEAST(whole + CAST(more AS BIGINT), 2) AS INTEGER) AS passes
FROM x
"""


_PLAIN = (
    "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)

OP5 = rf"""
WITH d AS (SELECT doc_id, ROW_NUMBER() OVER () AS rid, {_PLAIN} AS ws FROM (SELECT doc_id, COALESCE(text, '') AS text FROM documents)),
t AS (SELECT ROW_NUMBER() OVER () AS tid, item, ws, LEAST(10, len(ws)) AS n FROM (SELECT COALESCE(CAST(item_id AS VARCHAR), '') AS item, {_PLAIN} AS ws FROM (SELECT item_id, COALESCE(text, '') AS text FROM benchmark)) WHERE len(ws) > 0),
tw AS (SELECT tid, item, n, j, array_to_string(ws[j:j+n-1], ' ') AS k FROM t, UNNEST(range(1, len(ws) - n + 2)) AS u(j)),
dw AS (SELECT rid, i, n, array_to_string(ws[i:i+n-1], ' ') AS k FROM d, (SELECT DISTINCT n FROM t), UNNEST(range(1, len(ws) - n + 2)) AS u(i)),
hit AS (SELECT rid, i, n, item, tid, j FROM dw JOIN tw USING (n, k)),
hw AS (SELECT rid, COUNT(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM hit), UNNEST(range(i, i + n)) AS u(p) GROUP BY 1),
hi AS (SELECT rid, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY 1),
run AS (SELECT *, i - ROW_NUMBER() OVER (PARTITION BY rid, tid, i - j ORDER BY i) AS g FROM hit),
far AS (SELECT rid, item, MIN(i) AS i, CAST(MAX(i) - MIN(i) + ANY_VALUE(n) AS BIGINT) AS words FROM run GROUP BY rid, tid, item, i - j, g),
top AS (SELECT rid, words, i, item FROM far QUALIFY ROW_NUMBER() OVER (PARTITION BY rid ORDER BY words DESC, i, item) = 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
  sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated, COALESCE(words, 0) AS longest,
  CAST(top.i - 1 AS BIGINT) AS longest_start, top.item AS longest_item
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid) LEFT JOIN top USING (rid)
"""


OP11 = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, ROW_NUMBER() OVER () AS row,
  list_transform(embedding, lambda x: CAST(FLOOR(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same,
  CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.row <> b.row),
p AS (SELECT * FROM s WHERE same QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.row, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  ROW_NUMBER() OVER (PARTITION BY p.anchor, p.row ORDER BY s.score DESC, s.vec_id, s.row) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

OP12 = r"""
WITH d AS (SELECT COALESCE(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
pc AS (SELECT lang, UNNEST(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pc),
g AS (SELECT lang, k AS size, array_to_string(ws[i:i+k-1], ' ') AS phrase FROM w, UNNEST(range(1, 6)) AS u(k), UNNEST(range(1, len(ws) - k + 2)) AS v(i)),
f AS (SELECT lang, size, phrase, COUNT(*) AS a FROM g GROUP BY ALL HAVING COUNT(*) >= 100),
n AS (SELECT lang, SUM(len(ws))::BIGINT AS n FROM w GROUP BY 1),
c AS (SELECT f.*, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
cut AS (SELECT c.lang, c.phrase, c.size, c.a, k, array_to_string(ws[1:k], ' ') AS p1, array_to_string(ws[k+1:], ' ') AS p2 FROM c, UNNEST(range(1, c.size)) AS u(k)),
s AS (SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, n.n, (1000::HUGEINT * cut.a * n.n) // (x.a::HUGEINT * y.a) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = p1 JOIN f y ON y.lang = cut.lang AND y.phrase = p2 JOIN n ON n.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.a >= b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND c.phrase <> b.phrase))
SELECT lang, ROW_NUMBER() OVER w AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY ROW_NUMBER() OVER w <= 2000
"""


def oracle_sql():
    """The other operators rest on fingerprints, components, automata, models or file formats; they are tested
    against brute force, exact round trips or held-out text in tests/llm."""
    return {"op1_quality_rules": OP1, "op4_source_mix": OP4, "op5_decontaminate": OP5, "op11_hard_negatives": OP11, "op12_collocations": OP12}
