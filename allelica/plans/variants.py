"""Queries of variants of the statistics: flat pairs, differences of ratios, trimmed blocks, errors of heterozygosity,
and the spectrum's file."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelica.operators import blocks, counts, fstats, jackknife, qc
from allelica.plans import oracle as o
from allelica.plans.files import scratch
from allelica.plans.queries import POPS, QUADS, markers, query, rounded
from allelica.sources import adapter, formats

RATIOS = [(0, 1, 2, 3, 0, 4, 2, 3), (1, 2, 3, 4, 1, 0, 3, 4)]
SHARES = [((0, 1, 2, 3, 0, 4, 2, 3), (2, 1, 0, 4, 2, 3, 0, 4)), ((1, 2, 3, 4, 1, 0, 3, 4), (3, 0, 1, 4, 3, 2, 1, 4))]
TRIM = 0.05


def _flat(a: int, b: int, c: int, d: int) -> str:
    return f"CASE WHEN ABS(p{a} - p{b}) < 1e-5 OR ABS(p{c} - p{d}) < 1e-5 THEN 0 ELSE {o.f4(a, b, c, d)} END"


@query(o.blocks() + o.WIDE + o.sums([(_flat(*q[:4]), _flat(*q[4:])) for q in RATIOS]) + o.jack(o.STANDARD.format(name="alpha")))
def f4_ratio_flat(spark, sf_dir):
    return rounded(fstats.f4_ratio(markers(spark, sf_dir), RATIOS, flat=True).drop("z"), "alpha", "se")


_FOUR = " UNION ALL ".join(
    f"SELECT {k} AS qid, block, " + ", ".join(f"{o.f4(*q[i : i + 4])} AS {n}{j}" for j, q in enumerate(pair, 1) for i, n in ((0, "t"), (4, "b"))) + " FROM wide"
    for k, pair in enumerate(SHARES)
)


@query(o.blocks() + o.WIDE + f""", terms AS ({_FOUR}),
sums AS (SELECT qid, block, SUM(t1) AS top, SUM(b1) AS bot, SUM(t2) AS t2, SUM(b2) AS b2, COUNT(*) AS n FROM terms WHERE t1 + b1 + t2 + b2 IS NOT NULL GROUP BY 1, 2),
joint AS (SELECT *, SUM(t2) OVER w AS st2, SUM(b2) OVER w AS sb2 FROM sums WINDOW w AS (PARTITION BY qid))"""
    + o.jack(o.STANDARD.format(name="excess"), "st / sb + st2 / sb2 - 1", "(st - top) / (sb - bot) + (st2 - t2) / (sb2 - b2) - 1").replace("FROM sums WINDOW", "FROM joint WINDOW"))
def f4_ratio_difference(spark, sf_dir):
    return rounded(fstats.f4_ratio_difference(markers(spark, sf_dir), [a + b for a, b in SHARES]).drop("z"), "excess", "se")


_WHOLE = o.jack("qid, se AS whole_se").lstrip(",\n")
_LESS = "ROUND((SUM(top) OVER w - top) / (SUM(bot) OVER w - bot), 12)"


@query(o.blocks() + o.WIDE + o.sums([(o.f4(*q), f"CASE WHEN {o.f4(*q)} IS NOT NULL THEN 1.0 END") for q in QUADS]) + f""",
wholes AS (WITH {_WHOLE}),
less AS (SELECT *, {_LESS} AS d FROM sums WINDOW w AS (PARTITION BY qid)),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY d, block) AS r, COUNT(*) OVER (PARTITION BY qid) AS c FROM less),
middle AS (SELECT * FROM ranked WHERE r > FLOOR(c * {TRIM} + 0.5) AND r <= c - FLOOR(c * {TRIM} + 0.5))"""
    + o.jack("qid, ROUND(mean, 6) AS f4, ROUND(whole_se, 6) AS se, blocks").replace("FROM sums WINDOW", "FROM middle WINDOW").replace("FROM jk JOIN tn USING (qid)", "FROM jk JOIN wholes USING (qid)"))
def f4_trimmed(spark, sf_dir):
    sums = fstats.d_blocks(markers(spark, sf_dir), QUADS, f4mode=True)
    return rounded(jackknife.trimmed(sums, ["qid"], TRIM).select("qid", F.col("jack").alias("f4"), "se", "blocks"), "f4", "se")


@query(o.blocks() + """, held AS (SELECT block, COUNT(DISTINCT snp) AS n FROM moments JOIN blocked USING (snp) GROUP BY 1),
pairs AS (SELECT a.pop AS a, b.pop AS b, block, CAST(SUM(CASE WHEN a.pop = b.pop THEN 2 * a.n0 * a.n1 ELSE a.n0 * b.n1 + a.n1 * b.n0 END) AS DOUBLE) AS top,
  CAST(SUM(CASE WHEN a.pop = b.pop THEN a.n * (a.n - 1) ELSE a.n * b.n END) AS DOUBLE) AS bot
  FROM moments a JOIN moments b ON a.snp = b.snp AND a.pop <= b.pop JOIN blocked k ON k.snp = a.snp GROUP BY 1, 2, 3),
sums AS (SELECT a * 5 + b AS qid, h.block, COALESCE(top, 0) AS top, COALESCE(bot, 0) AS bot, n FROM held h CROSS JOIN (SELECT DISTINCT a, b FROM pairs) LEFT JOIN pairs USING (a, b, block))"""
    + o.jack("qid // 5 AS a, qid % 5 AS b, ROUND(mean, 6) AS het, ROUND(se, 6) AS se, blocks"))
def het_matrix_jackknife(spark, sf_dir):
    return rounded(fstats.heterozygosity_errors(markers(spark, sf_dir), POPS), "het", "se")


_FOUND = o.jack("qid, ROUND(est, 6) AS share, ROUND(se, 6) AS se").lstrip(",\n")


@query(o.SPECTRUM + f""", found AS (WITH {_FOUND}),
grid AS (SELECT UNNEST(range(9)) AS qid)
SELECT CAST(qid // 3 AS INTEGER) AS k0, CAST(qid % 3 AS INTEGER) AS k1, COALESCE(share, 0) AS share, GREATEST(COALESCE(se, 0), (SELECT MIN(se) FROM found WHERE se > 0)) AS se FROM grid LEFT JOIN found USING (qid)""")
def spectrum_file(spark, sf_dir):
    """The joint spectrum of two populations written to a spectrum file and read from there."""
    d, sizes, path = adapter.load(spark, sf_dir), {1: 2, 2: 2}, scratch(spark)
    sums = qc.spectrum_blocks(counts.allele_counts(d.genotype, d.sample), sizes, blocks.assign_blocks(d.marker))
    found = rounded(jackknife.ratio(sums, ["k0", "k1"]).select("k0", "k1", F.col("est").alias("share"), "se"), "share", "se")
    formats.spectrum_lines(found, sizes).write.text(path)
    return formats.read_spectrum(spark, path, len(sizes))
