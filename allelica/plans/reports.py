"""Registered queries of filters, transforms, merges and reports that stand beside the f-statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelica.operators import blocks, counts, filters, fstats, jackknife, linkage, merges, qc, transforms
from allelica.plans import oracle as o
from allelica.plans.queries import BAND, POPS, QUADS, alleles, markers, query, rounded
from allelica.sources import adapter

X = 22  # the adapter's last chromosome serves as X


def name_of():
    return F.concat(F.lit("s"), (F.col("snp") * 37 % 1000).cast("string"))


@query(o.ADAPTER + "SELECT 's' || CAST(snp * 37 % 1000 AS VARCHAR) AS name, COUNT(*) AS copies FROM marker GROUP BY 1 HAVING COUNT(*) > 1")
def duplicate_markers(spark, sf_dir):
    return qc.duplicate_ids(adapter.load(spark, sf_dir).marker, name_of())


@query(o.ADAPTER + ", t AS (SELECT snp, chrom, physpos // 600000 AS physpos FROM marker), l AS (SELECT LAG(snp) OVER w AS before, snp, chrom, physpos, LAG(physpos) OVER w AS last FROM t WINDOW w AS (PARTITION BY chrom ORDER BY physpos, snp)) SELECT before, snp, chrom, physpos FROM l WHERE last = physpos")
def duplicate_positions(spark, sf_dir):
    m = adapter.load(spark, sf_dir).marker
    return qc.duplicate_positions(m.select("snp", "chrom", F.floor(F.col("physpos") / 600_000).alias("physpos")))


@query(o.ADAPTER + "SELECT snp, chrom, physpos FROM marker WHERE physpos BETWEEN 5000000 AND 30000000 AND chrom BETWEEN 1 AND 20")
def position_range(spark, sf_dir):
    m = adapter.load(spark, sf_dir).marker
    return filters.chromosome_range(filters.positions(m, 5_000_000, 30_000_000), 1, 20).select("snp", "chrom", "physpos")


@query(o.ADAPTER + "SELECT sample, pop FROM sample WHERE sample IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)")
def listed_samples(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity = 50").select(F.col("l_suppkey").alias("sample"))
    return filters.listed_samples(adapter.load(spark, sf_dir).sample, names).select("sample", "pop")


@query(o.ADAPTER + f"SELECT g.* FROM genotype g LEFT JOIN marker m USING (snp) LEFT JOIN sample s USING (sample) WHERE NOT (g = 1 AND COALESCE(chrom = {X} AND sex = 'M', FALSE))")
def male_x_hets(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return filters.without_male_x_hets(d.genotype, d.sample, d.marker, X)


@query(o.ADAPTER + """, r AS (SELECT s.snp, (COALESCE(n0, 0) + COALESCE(n1, 0) + 2) * (COALESCE(n0, 0) + COALESCE(n1, 0) + 1) / CAST((COALESCE(n0, 0) + 1) * (COALESCE(n1, 0) + 1) AS DOUBLE) AS raw
  FROM (SELECT DISTINCT snp FROM counts) s LEFT JOIN (SELECT * FROM counts WHERE pop = 3) c USING (snp)) SELECT snp, ROUND(raw / AVG(raw) OVER (), 6) AS weight FROM r""")
def explicit_weights(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return rounded(filters.explicit_weights(counts.allele_counts(d.genotype, d.sample), 3), "weight")


_CLASS = "CASE ref || alt WHEN 'AC' THEN 0 WHEN 'TG' THEN 0 WHEN 'AG' THEN 1 WHEN 'TC' THEN 1 WHEN 'AT' THEN 2 WHEN 'TA' THEN 2 WHEN 'CA' THEN 3 WHEN 'GT' THEN 3 WHEN 'CG' THEN 4 WHEN 'GC' THEN 4 WHEN 'CT' THEN 5 WHEN 'GA' THEN 5 END"


@query(o.ADAPTER + f"SELECT snp, ref, alt FROM alleles WHERE {_CLASS} NOT IN (1, 5)")
def transversions(spark, sf_dir):
    return filters.allele_pairs(alleles(adapter.load(spark, sf_dir)), 2).select("snp", "ref", "alt")


@query(o.ADAPTER + """, p AS (SELECT DISTINCT pop, pop % 3 AS kind FROM sample), q AS (SELECT a.pop AS a, b.pop AS b, c.pop AS c, d.pop AS d, [a.kind, b.kind, c.kind, d.kind] AS t
  FROM p a JOIN p b ON a.pop < b.pop JOIN p c ON b.pop < c.pop JOIN p d ON c.pop < d.pop)
SELECT a, b, c, d FROM q WHERE len(list_filter(t, lambda x: x = 1)) > 0 AND (len(list_filter(t, lambda x: x = 2)) >= 2 OR len(list_filter(t, lambda x: x = 2)) = (SELECT COUNT(*) FROM p WHERE kind = 2))""")
def banker_tuples(spark, sf_dir):
    p = adapter.load(spark, sf_dir).sample.select("pop", (F.col("pop") % 3).alias("kind")).distinct()
    q = None
    for c in "abcd":
        own = p.select(F.col("pop").alias(c), F.col("kind").alias(f"k{c}"))
        q = own if q is None else q.join(own, F.col(c) > F.col(chr(ord(c) - 1)))
    return q.where(filters.legal_tuple(F.array("ka", "kb", "kc", "kd"), p.where("kind = 2").count())).select("a", "b", "c", "d")


@query(o.ADAPTER + "SELECT snp, sample + 500000 AS sample, g FROM genotype UNION ALL SELECT snp, sample + 700000, g FROM genotype WHERE sample <= 5")
def remap_samples(spark, sf_dir):
    g = adapter.load(spark, sf_dir).genotype
    old = g.select("sample").distinct()
    names = old.select("sample", (F.col("sample") + 500_000).alias("new")).unionByName(old.where("sample <= 5").select("sample", (F.col("sample") + 700_000).alias("new")))
    return merges.remap_samples(g, names)


@query(o.ADAPTER + "SELECT snp, CASE WHEN snp IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) THEN TRANSLATE(ref, 'ACGT', 'TGCA') ELSE ref END AS ref, CASE WHEN snp IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) THEN TRANSLATE(alt, 'ACGT', 'TGCA') ELSE alt END AS alt FROM alleles")
def strand_flips(spark, sf_dir):
    listed = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity = 50").select(F.col("l_partkey").alias("snp"))
    return transforms.strand_flip(alleles(adapter.load(spark, sf_dir)), listed).select("snp", "ref", "alt")


@query(o.ADAPTER + ", t AS (SELECT snp, chrom, physpos, (genpos // 60000) * 60000 / CAST(1e7 AS DOUBLE) AS genpos FROM marker) SELECT snp, chrom, ROUND(genpos + 1e-9 * (ROW_NUMBER() OVER (PARTITION BY chrom, genpos ORDER BY physpos, snp) - 1), 9) AS genpos FROM t")
def tiny_distances(spark, sf_dir):
    m = adapter.load(spark, sf_dir).marker
    coarse = m.select("snp", "chrom", "physpos", (F.floor(F.col("genpos") / 60_000) * 60_000 / F.lit(1e7)).alias("genpos"))
    return transforms.apart(coarse).select("snp", "chrom", F.round("genpos", 9).alias("genpos"))


@query(o.ADAPTER + "SELECT g.* FROM genotype g WHERE snp NOT IN (SELECT snp FROM marker WHERE chrom = 3)")
def wiped_chromosome(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return transforms.wipe_chromosome(d.genotype, d.marker, 3)


@query(o.ADAPTER + "SELECT m.snp, COUNT(DISTINCT s.pop) AS pops, (SELECT COUNT(DISTINCT pop) FROM sample) - COUNT(DISTINCT s.pop) AS missing_pops FROM marker m LEFT JOIN genotype g ON g.snp = m.snp LEFT JOIN sample s ON s.sample = g.sample GROUP BY 1")
def missing_populations(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return qc.missing_populations(d.genotype, d.sample, d.marker)


@query(o.ADAPTER + "SELECT sample, COUNT(*) AS calls, CAST(SUM((snp * 2654435761 + (g + 1) * 40503 * (snp % 65521 + 1)) % 4294967291) AS BIGINT) AS print FROM genotype GROUP BY 1")
def sample_fingerprints(spark, sf_dir):
    return qc.fingerprints(adapter.load(spark, sf_dir).genotype)


@query(o.ADAPTER + f""", t AS (SELECT snp, g, CAST(affected AS DOUBLE) AS y, CAST(CASE WHEN sex = 'M' AND chrom = {X} THEN g // 2 ELSE g END AS DOUBLE) AS x FROM genotype JOIN sample USING (sample) JOIN marker USING (snp)),
s AS (SELECT snp, COUNT(*) AS n, SUM(g) AS ref, SUM(x) AS sx, SUM(y) AS sy, SUM(x * x) AS xx, SUM(y * y) AS yy, SUM(x * y) AS xy FROM t GROUP BY 1)
SELECT snp, n, ROUND(CASE WHEN ref > 0 AND ref < 2 * n AND sy > 0 AND sy < n AND (n * xx - sx * sx) * (n * yy - sy * sy) > 0 THEN n * POW(n * xy - sx * sy, 2) / ((n * xx - sx * sx) * (n * yy - sy * sy)) ELSE 0 END, 5) AS chi2 FROM s""")
def trend_test(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return qc.trend_test(d.genotype, d.sample, d.marker, X).withColumn("chi2", F.round("chi2", 5))


@query(o.ADAPTER + f""", t AS (SELECT snp, sex = 'M' AS male, CASE WHEN sex = 'M' AND chrom = {X} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w, g FROM genotype JOIN sample USING (sample) JOIN marker USING (snp)),
c AS (SELECT snp, SUM(CASE WHEN male THEN w * (2 - g) ELSE 0 END) + 1e-8 AS a, SUM(CASE WHEN male THEN w * g ELSE 0 END) + 1e-8 AS b, SUM(CASE WHEN male THEN 0 ELSE w * (2 - g) END) + 1e-8 AS c, SUM(CASE WHEN male THEN 0 ELSE w * g END) + 1e-8 AS d FROM t GROUP BY 1)
SELECT snp, ROUND(CASE WHEN a * d - b * c < 0 THEN -1 ELSE 1 END * SQRT(POW(a * d - b * c, 2) * (a + b + c + d) / ((a + b) * (c + d) * (a + c) * (b + d)) + 1e-12), 3) + 0.0 AS z FROM c WHERE a + c > 1e-3 AND b + d > 1e-3 AND a + b > 1e-3 AND c + d > 1e-3""")
def sex_difference(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    both = d.genotype.join(d.sample, "sample").join(d.marker, "snp").groupBy("snp").agg(F.count_distinct("sex").alias("k"), F.sum("g").alias("ref"), F.sum(2 - F.col("g")).alias("other"))
    seen = both.where("k = 2 and ref > 0 and other > 0").select("snp")
    return qc.sex_difference(d.genotype, d.sample, d.marker, X).join(seen, "snp", "left_semi").withColumn("z", F.round("z", 3) + 0.0)


@query(o.ADAPTER + o.pairs(BAND) + "SELECT snp1, snp2, n, CASE WHEN (n * xx - x * x) * (n * yy - y * y) > 0 THEN ROUND(n * POW(n * xy - x * y, 2) / CAST((n * xx - x * x) * (n * yy - y * y) AS DOUBLE), 5) END AS chi2 FROM tables")
def pair_chi_square(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    tables = linkage.pair_tables(d.genotype, d.marker, BAND)
    # Half up in doubles, as the SQL's ROUND: Spark's own works on the decimal digits, which tie otherwise.
    return linkage.chi_square(tables).select("snp1", "snp2", "n", (F.floor(F.col("chi2") * 1e5 + 0.5) / 1e5).alias("chi2"))


@query(o.ADAPTER + o.pairs(BAND) + """, w AS (SELECT a.snp, a.p - b.p AS w FROM moments a JOIN moments b ON a.snp = b.snp AND a.pop = 1 AND b.pop = 2),
t AS (SELECT chrom, distance // 100000 AS bin, (xy - x * y / CAST(n AS DOUBLE)) / (n - 1) AS ld, a.w * b.w AS w FROM tables JOIN w a ON a.snp = snp1 JOIN w b ON b.snp = snp2 WHERE n >= 4),
c AS (SELECT DISTINCT chrom FROM t)
SELECT c.chrom, bin, COUNT(*) AS pairs, ROUND(SUM(ld * w) / SUM(w * w), 6) AS regression FROM t JOIN c ON t.chrom <> c.chrom GROUP BY 1, 2""")
def decay_without_each(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    m = counts.moments(counts.allele_counts(d.genotype, d.sample))
    weighted = d.marker.join(linkage.frequency_difference(m, 1, 2), "snp")
    tables = linkage.pair_tables(d.genotype, weighted, BAND, ("weight",))
    return rounded(linkage.decay_without_each(linkage.decay_sums(tables, 100_000)), "regression")


@query(o.ADAPTER + o.pairs(500_000) + """, linked AS (SELECT * FROM tables WHERE (n * xx - x * x) * (n * yy - y * y) > 0 AND POW(n * xy - x * y, 2) / CAST((n * xx - x * x) * (n * yy - y * y) AS DOUBLE) >= 0.2),
scores AS (SELECT snp, m.chrom, genpos, COUNT(*) AS score FROM genotype JOIN marker m USING (snp) GROUP BY 1, 2, 3),
firsts AS (SELECT a.chrom, ROW_NUMBER() OVER (PARTITION BY a.chrom ORDER BY a.genpos) AS k, a.snp, a.score, LIST({snp: b.snp, score: b.score}) AS rest
  FROM linked JOIN scores a ON a.snp = snp1 JOIN scores b ON b.snp = snp2 GROUP BY a.chrom, a.genpos, a.snp, a.score),
walk AS (SELECT DISTINCT chrom, 0::BIGINT AS k, []::BIGINT[] AS gone FROM firsts
  UNION ALL SELECT f.chrom, f.k, CASE WHEN LIST_CONTAINS(gone, f.snp) OR LEN(LIST_FILTER(rest, lambda r: NOT LIST_CONTAINS(gone, r.snp))) = 0 THEN gone
    WHEN LIST_MAX(LIST_TRANSFORM(LIST_FILTER(rest, lambda r: NOT LIST_CONTAINS(gone, r.snp)), lambda r: r.score)) > f.score THEN LIST_APPEND(gone, f.snp)
    ELSE LIST_CONCAT(gone, LIST_TRANSFORM(LIST_FILTER(rest, lambda r: NOT LIST_CONTAINS(gone, r.snp)), lambda r: r.snp)) END
  FROM walk w JOIN firsts f ON f.chrom = w.chrom AND f.k = w.k + 1),
removed AS (SELECT DISTINCT UNNEST(gone) AS snp FROM (SELECT chrom, ARG_MAX(gone, k) AS gone FROM walk GROUP BY 1))
SELECT snp FROM scores WHERE snp NOT IN (SELECT snp FROM removed)""")
def linked_markers_pruned(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    linked = linkage.r_squared(linkage.pair_tables(d.genotype, d.marker, 500_000)).where("r2 >= 0.2")
    scores = d.genotype.groupBy("snp").agg(F.count("*").alias("score"))
    own = d.marker.select("snp", "chrom", F.col("genpos").alias("ord")).join(scores, "snp")
    return filters.linked_prune(own, linked)


_HIN = "2 * (x0 * x2 + (x0 + x2) * x1 / 2.0::DOUBLE + x1 * (x1 - 1) / 4.0::DOUBLE) / ((x0 + x1 + x2) * (x0 + x1 + x2 - 1))"


@query(o.blocks() + f""", sums AS (SELECT pop AS qid, block, SUM({_HIN} - x1 / CAST(x0 + x1 + x2 AS DOUBLE)) AS top, SUM({_HIN}) AS bot, COUNT(*) AS n
  FROM classes JOIN blocked USING (snp) WHERE x0 + x1 + x2 >= 2 GROUP BY 1, 2)""" + o.jack("qid AS pop, ROUND(est, 6) AS inbreeding, ROUND(se, 6) AS se, nsnp, blocks"))
def inbreeding(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    out = fstats.inbreeding(counts.class_counts(d.genotype, d.sample), blocks.assign_blocks(d.marker))
    return rounded(out, "inbreeding", "se")


_PAIRS = [(a, b) for a in POPS for b in POPS if a < b]
_NUM = "(p{a} - p{b}) * (p{a} - p{b}) + c{a} + c{b}"
_FST = o.blocks() + o.WIDE + o.sums([(_NUM.format(a=a, b=b), f"{_NUM.format(a=a, b=b)} + h{a} + h{b}") for a, b in _PAIRS]) + o.jack("qid, est, se")
_F2 = o.blocks() + o.WIDE + o.sums([(_NUM.format(a=a, b=b), f"CASE WHEN {_NUM.format(a=a, b=b)} IS NOT NULL THEN 1.0 END") for a, b in _PAIRS]) + o.jack("qid, est, se")


@query(f"SELECT ROUND(SUM(a.est * b.est / POW(a.se + 1e-10, 2)) / SUM(b.est * b.est / POW(a.se + 1e-10, 2)), 5) AS scale FROM ({_FST}) a JOIN ({_F2}) b USING (qid)")
def fst_scale(spark, sf_dir):
    return fstats.fst_scale(fstats.pair_matrix(markers(spark, sf_dir), POPS)).select(F.round("scale", 5).alias("scale"))


_RHO = "({c}12 - {c}1 * {c}2 / {c}n) / SQRT(({c}11 - {c}1 * {c}1 / {c}n) * ({c}22 - {c}2 * {c}2 / {c}n))"
_LESS = _RHO
for _k in ("12", "11", "22", "1", "2", "n"):
    _LESS = _LESS.replace(f"{{c}}{_k}", f"(t{_k} - b{_k})")


@query(o.blocks() + o.WIDE + ", f AS (" + " UNION ALL ".join(f"SELECT {k} AS qid, block, p{a} AS x, p{b} AS y FROM wide" for k, (a, b) in enumerate(_PAIRS)) + """),
b AS (SELECT qid, block, CAST(COUNT(*) AS DOUBLE) AS bn, SUM(x * x) AS b11, SUM(y * y) AS b22, SUM(x * y) AS b12, SUM(x) AS b1, SUM(y) AS b2 FROM f WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, """ + ", ".join(f"SUM(b{k}) OVER w AS t{k}" for k in ("n", "11", "22", "12", "1", "2")) + f""" FROM b WINDOW w AS (PARTITION BY qid)),
d AS (SELECT qid, bn, tn, tn / bn AS hk, {_RHO.format(c="t")} AS theta, {_LESS} AS del FROM t),
m AS (SELECT *, SUM(theta - del) OVER w + SUM(bn * del) OVER w / tn AS mean FROM d WINDOW w AS (PARTITION BY qid))
SELECT qid, ROUND(MAX(mean), 5) AS rho, ROUND(SQRT(SUM(POW(hk * theta - (hk - 1) * del - mean, 2) / (hk - 1)) / COUNT(*)), 5) AS se, COUNT(*) AS blocks FROM m GROUP BY 1""")
def frequency_correlation(spark, sf_dir):
    out = fstats.frequency_correlation(markers(spark, sf_dir), _PAIRS)
    return out.withColumns({c: F.round(c, 5) for c in ("rho", "se")})


@query(o.blocks() + o.WIDE + ", v AS (" + " UNION ALL ".join(f"SELECT {k} AS qid, block, {o.f4(*q)} AS v FROM wide" for k, q in enumerate(QUADS)) + """),
own AS (SELECT qid, block, AVG(v) AS mean, VAR_SAMP(v) / COUNT(*) AS var FROM v WHERE v IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) > 1 AND VAR_SAMP(v) > 0),
sums AS (SELECT qid, block, mean / var AS top, 1 / var AS bot, 1 / var AS n FROM own)""" + o.jack("qid, ROUND(mean, 5) AS f4, ROUND(se, 5) AS se, blocks"))
def f4_by_block_variance(spark, sf_dir):
    out = fstats.variance_weighted_f4(markers(spark, sf_dir), QUADS)
    return out.withColumns({c: F.round(c, 5) for c in ("f4", "se")})


_F4 = o.blocks() + o.WIDE + o.sums(o.dstat_parts(QUADS, True)) + o.jack("qid, est, se")


@query(f"SELECT ROUND(a.est - b.est, 6) AS diff, ROUND(SQRT(a.se * a.se + b.se * b.se), 6) AS se, ROUND(POW(a.est - b.est, 2) / (a.se * a.se + b.se * b.se), 4) AS chi2 FROM ({_F4}) a JOIN ({_F4}) b ON a.qid = 0 AND b.qid = 1")
def difference_of_estimates(spark, sf_dir):
    est = fstats.f4_statistic(markers(spark, sf_dir), QUADS).withColumnRenamed("f4", "est")
    return rounded(qc.difference(est, 0, 1), "diff", "se").withColumn("chi2", F.round("chi2", 4))


@query(o.blocks() + o.WIDE + o.sums(o.dstat_parts(QUADS[1:3], True)) + o.jack("qid + 2 AS line, ROUND(est, 6) AS f4, ROUND(se, 6) AS se"))
def query_lines(spark, sf_dir):
    chosen = fstats.subset(QUADS, 2, 3)
    out = fstats.f4_statistic(markers(spark, sf_dir), [q for _, q in chosen])
    return rounded(out.select((F.col("qid") + chosen[0][0]).alias("line"), "f4", "se"), "f4", "se")


_TRIPLES = [(a, b) for i, a in enumerate(POPS[1:]) for b in POPS[1 + i :]]


@query(o.blocks() + o.WIDE + o.sums([(f"(p{a} - p0) * (p{b} - p0) + c0" + (f" + c{a}" if a == b else ""), f"CASE WHEN p{a} + p{b} + c0{f' + c{a}' if a == b else ''} IS NOT NULL THEN 1.0 END") for a, b in _TRIPLES]) + o.jack("qid, ROUND(mean, 6) AS ff3, ROUND(se, 6) AS se, nsnp"))
def ff3_matrix(spark, sf_dir):
    sums = fstats.basis_blocks(markers(spark, sf_dir), POPS)
    total = sums.groupBy("qid").agg(F.sum("n").alias("nsnp"))
    out = jackknife.ratio(sums, ["qid"]).join(total, "qid").select("qid", F.col("jack").alias("ff3"), "se", "nsnp")
    return rounded(out, "ff3", "se")


_PART = o.blocks() + o.WIDE + o.sums([(f"({o.pattern('AABAB', q)} - {o.pattern('AABBA', q)}) * 1e6", f"CASE WHEN {o.pattern('AABAB', q)} IS NOT NULL THEN 1.0 END") for q in [(0, 1, 2, 3, 4), (4, 3, 2, 1, 0)]]) + o.jack("qid, ROUND(est, 2) AS score, ROUND(se, 2) AS se, nsnp, blocks")


@query(_PART)
def dpart_scaled(spark, sf_dir):
    out = fstats.partitioned_d(markers(spark, sf_dir), [(0, 1, 2, 3, 4), (4, 3, 2, 1, 0)], "AABAB", "AABBA", fmode=True)
    return out.select("qid", F.round("score", 2).alias("score"), F.round("se", 2).alias("se"), "nsnp", "blocks")


@query(o.SPECTRUM + o.jack("qid // 3 AS k0, qid % 3 AS k1, ROUND(est, 6) AS share, ROUND(se, 6) AS se"))
def spectrum_jackknife(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    sums = qc.spectrum_blocks(counts.allele_counts(d.genotype, d.sample), {1: 2, 2: 2}, blocks.assign_blocks(d.marker))
    out = jackknife.ratio(sums, ["k0", "k1"]).select("k0", "k1", F.col("est").alias("share"), "se")
    return rounded(out, "share", "se")


@query(o.ADAPTER + """, h AS (SELECT snp, pop, g, chrom = 22 AND sample % 2 = 0 AS hap FROM genotype JOIN sample USING (sample) JOIN marker USING (snp)),
c AS (SELECT snp, pop, COUNT(*) FILTER (NOT hap AND g = 0) AS x0, COUNT(*) FILTER (NOT hap AND g = 1) AS x1, COUNT(*) FILTER (NOT hap AND g = 2) AS x2, COUNT(*) FILTER (hap AND g = 0) AS w0, COUNT(*) FILTER (hap AND g = 2) AS w1 FROM h GROUP BY 1, 2),
f AS (SELECT *, x0 + x1 + x2 AS f, w0 + w1 AS m FROM c)
SELECT snp, pop, ROUND((2 * x2 + x1 + w1) / CAST(2 * f + m AS DOUBLE), 6) AS p, CASE WHEN f + m >= 2 THEN ROUND((4 * x0 * x2 + 2 * x2 * x1 + 2 * x0 * x1 + x1 * (x1 - 1) + (2 * x0 + x1) * w1 + (2 * x2 + x1) * w0 + w0 * w1)
  / CAST(4 * f * (f - 1) + 4 * f * m + m * (m - 1) AS DOUBLE), 6) END AS h FROM f WHERE f + m > 0""")
def freq_het_hemizygous(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    rows = d.genotype.join(d.marker.select("snp", "chrom"), "snp")
    own = d.sample.select("sample", "pop")
    last, rest = rows.where("chrom = 22"), rows.where("chrom <> 22")
    both = counts.hemizygous_classes(last, own, F.col("sample") % 2 == 0).unionByName(counts.hemizygous_classes(rest, own, F.lit(False)))
    return rounded(counts.inbred_moments(both.where("x0 + x1 + x2 + w0 + w1 > 0")).select("snp", "pop", "p", "h"), "p", "h")
