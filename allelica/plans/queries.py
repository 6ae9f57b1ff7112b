"""The registered queries of the genotype engine: each applies operators to the adapter's relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelica.functions.alleles import match_code
from allelica.operators import blocks, counts, filters, fstats, jackknife, linkage, merges, qc, transforms
from allelica.plans import oracle as o
from allelica.sources import adapter

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}

QUADS = [(1, 2, 3, 4), (0, 1, 2, 3), (0, 2, 1, 4)]
POPS = [0, 1, 2, 3, 4]
BAND = 1_000_000


def query(sql: str | None):
    """Registers a query under its name; ``sql`` is its DuckDB text, or None where SQL does not express it."""

    def add(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per marker with its block and its populations' moments."""
    d = adapter.load(spark, sf_dir)
    stats = counts.moments(counts.allele_counts(d.genotype, d.sample))
    return counts.by_marker(stats.join(blocks.assign_blocks(d.marker).select("snp", "block"), "snp"))


def alleles(d: adapter.Dataset) -> DataFrame:
    letters = F.array(*map(F.lit, "ACGT"))
    return d.marker.withColumns({"ref": letters[(F.col("snp") % 4).cast("int")], "alt": letters[((F.col("snp") + 1 + F.col("snp") % 2) % 4).cast("int")]})


def alleles2(d: adapter.Dataset) -> DataFrame:
    k, c = F.col("snp") % 5, lambda x: F.translate(x, "ACGT", "TGCA")
    ref = F.when(k == 0, F.col("alt")).when(k == 1, c("ref")).otherwise(F.col("ref"))
    alt = F.when(k == 0, F.col("ref")).when(k == 1, c("alt")).when(k == 2, F.col("ref")).otherwise(F.col("alt"))
    return alleles(d).withColumns({"__r": ref, "__a": alt}).drop("ref", "alt").withColumnsRenamed({"__r": "ref", "__a": "alt"})


@query(o.ADAPTER + "SELECT snp, pop, n0, n1 FROM counts")
def allele_counts(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return counts.allele_counts(d.genotype, d.sample)


@query(o.ADAPTER + ", hap AS (SELECT snp, pop, g, chrom = 22 AND sample % 2 = 0 AS hap FROM genotype JOIN sample USING (sample) JOIN marker USING (snp)) "
       "SELECT snp, pop, CAST(SUM(CASE WHEN hap THEN 1 - g // 2 ELSE 2 - g END) AS BIGINT) AS n0, CAST(SUM(CASE WHEN hap THEN g // 2 ELSE g END) AS BIGINT) AS n1 "
       "FROM hap WHERE NOT (hap AND g = 1) GROUP BY 1, 2")  # fmt: skip
def allele_counts_haploid(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    last = d.genotype.join(d.marker.where("chrom = 22").select("snp"), "snp", "left_semi")
    rest = d.genotype.join(d.marker.where("chrom < 22 or chrom > 22").select("snp"), "snp", "left_semi")
    both = counts.allele_counts(last, d.sample, F.col("sample") % 2 == 0).unionByName(counts.allele_counts(rest, d.sample))
    return both.where("n0 + n1 > 0")


@query(o.ADAPTER + "SELECT * FROM classes")
def genotype_class_counts(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return counts.class_counts(d.genotype, d.sample)


@query(o.ADAPTER + "SELECT snp, pop, ROUND(p, 6) AS p, ROUND(h, 6) AS h, ROUND(c, 6) AS c FROM moments")
def freq_het(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return rounded(counts.moments(counts.allele_counts(d.genotype, d.sample)).select("snp", "pop", "p", "h", "c"), "p", "h", "c")


@query(o.ADAPTER + ", t AS (SELECT snp, pop, x0 + x1 + x2 AS f, 2 * x2 + x1 AS n1, 4 * x0 * x2 + 2 * x2 * x1 + 2 * x0 * x1 + x1 * (x1 - 1) AS pairs FROM classes) "
       "SELECT snp, pop, ROUND(n1 / CAST(2 * f AS DOUBLE), 6) AS p, CASE WHEN f >= 2 THEN ROUND(pairs / CAST(4 * f * (f - 1) AS DOUBLE), 6) END AS h FROM t")  # fmt: skip
def freq_het_inbred(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return rounded(counts.inbred_moments(counts.class_counts(d.genotype, d.sample)).select("snp", "pop", "p", "h"), "p", "h")


@query(o.blocks() + "SELECT snp, chrom, block FROM blocked")
def block_assign(spark, sf_dir):
    return blocks.assign_blocks(adapter.load(spark, sf_dir).marker).select("snp", "chrom", "block")


@query(o.blocks() + o.WIDE + o.sums([(o.f4(1, 2, 3, 4), "CASE WHEN p1 + p2 + p3 + p4 IS NOT NULL THEN 1.0 END")]) + "SELECT block, ROUND(top, 6) AS top, n FROM sums")
def block_sums_f4(spark, sf_dir):
    return rounded(fstats.f4_vector_blocks(markers(spark, sf_dir), [1, 2], [3, 4]).select("block", "top", "n"), "top")


@query(o.blocks() + o.WIDE + o.sums(o.dstat_parts(QUADS, True)) + o.jack(o.STANDARD.format(name="f4") + ", ROUND(mean / se, 4) AS z"))
def f4_jackknife(spark, sf_dir):
    out = fstats.f4_statistic(markers(spark, sf_dir), QUADS)
    return rounded(out.select("qid", "f4", "se", "nsnp", "blocks", "z"), "f4", "se").withColumn("z", F.round("z", 4))


@query(o.blocks() + o.WIDE + o.sums(o.dstat_parts(QUADS)) + o.jack(o.STANDARD.format(name="d") + ", ROUND(mean / se, 4) AS z"))
def dstat_jackknife(spark, sf_dir):
    out = fstats.dstat(markers(spark, sf_dir), QUADS)
    return rounded(out.select("qid", "d", "se", "nsnp", "blocks", "z"), "d", "se").withColumn("z", F.round("z", 4))


@query(o.blocks() + o.WIDE + o.sums(o.dstat_parts(fstats.three_pairings(POPS))) + o.jack(o.STANDARD.format(name="d")))
def dstat_three_pairings(spark, sf_dir):
    out = fstats.dstat(markers(spark, sf_dir), fstats.three_pairings(POPS))
    return rounded(out.select("qid", "d", "se", "nsnp", "blocks"), "d", "se")


TRIPLES = [(0, 1, 2), (1, 2, 3), (3, 4, 0), (2, 4, 1)]


@query(o.blocks() + o.WIDE + o.sums([(f"(p{c} - p{a}) * (p{c} - p{b}) + c{c}", f"2 * h{c}") for a, b, c in TRIPLES]) + o.jack("qid, ROUND(est, 6) AS f3, ROUND(se, 6) AS se, blocks"))
def f3_ratio(spark, sf_dir):
    return rounded(fstats.f3(markers(spark, sf_dir), TRIPLES).select("qid", "f3", "se", "blocks"), "f3", "se")


_PAIRS = [(a, b) for a in POPS for b in POPS if a < b]
_NUM = "(p{a} - p{b}) * (p{a} - p{b}) + c{a} + c{b}"


@query(o.blocks() + o.WIDE + o.sums([(_NUM.format(a=a, b=b), f"{_NUM.format(a=a, b=b)} + h{a} + h{b}") for a, b in _PAIRS]) + o.jack("qid, ROUND(est, 6) AS fst, ROUND(se, 6) AS fst_se, nsnp"))
def fst_matrix(spark, sf_dir):
    out = fstats.pair_matrix(markers(spark, sf_dir), POPS).select(*[F.col(c) for c in ("a", "b", "fst", "fst_se", "nsnp")])
    index = F.create_map(*[x for k, (a, b) in enumerate(_PAIRS) for x in (F.lit(f"{a},{b}"), F.lit(k))])
    return rounded(out.select(index[F.concat_ws(",", "a", "b")].alias("qid"), "fst", "fst_se", "nsnp"), "fst", "fst_se")


@query(o.blocks() + o.WIDE + o.sums([(_NUM.format(a=a, b=b), f"CASE WHEN {_NUM.format(a=a, b=b)} IS NOT NULL THEN 1.0 END") for a, b in _PAIRS]) + o.jack("qid, ROUND(est, 6) AS f2, ROUND(se, 6) AS f2_se, nsnp"))
def f2_matrix(spark, sf_dir):
    out = fstats.pair_matrix(markers(spark, sf_dir), POPS)
    index = F.create_map(*[x for k, (a, b) in enumerate(_PAIRS) for x in (F.lit(f"{a},{b}"), F.lit(k))])
    return rounded(out.select(index[F.concat_ws(",", "a", "b")].alias("qid"), "f2", "f2_se", "nsnp"), "f2", "f2_se")


_RATIO = [(0, 1, 2, 3, 0, 1, 4, 3), (4, 1, 0, 3, 4, 1, 2, 3)]


@query(o.blocks() + o.WIDE + o.sums([(o.f4(*q[:4]), o.f4(*q[4:])) for q in _RATIO]) + o.jack("qid, ROUND(est, 5) AS alpha, ROUND(se, 5) AS se, nsnp, blocks"))
def f4_ratio(spark, sf_dir):
    out = fstats.f4_ratio(markers(spark, sf_dir), _RATIO).select("qid", "alpha", "se", "nsnp", "blocks")
    return out.withColumns({c: F.round(c, 5) for c in ("alpha", "se")})


_DIFF = [(0, 1, 2, 3, 0, 1, 4, 3), (1, 2, 3, 4, 0, 2, 1, 4)]


@query(o.blocks() + o.WIDE + o.sums([(f"{o.f4(*q[:4])} * 1.2 - {o.f4(*q[4:])}", f"CASE WHEN {o.f4(*q[:4])} + {o.f4(*q[4:])} IS NOT NULL THEN 1.0 END") for q in _DIFF]) + o.jack(o.STANDARD.format(name="diff")))
def f4_diff_overlap(spark, sf_dir):
    return rounded(fstats.f4_difference(markers(spark, sf_dir), _DIFF, 1.2).select("qid", "diff", "se", "nsnp", "blocks"), "diff", "se")


_APART = " UNION ALL ".join(f"SELECT {k} AS qid, block, {o.f4(*q[:4])} AS a, {o.f4(*q[4:])} AS b FROM wide" for k, q in enumerate(_DIFF))


@query(o.blocks() + o.WIDE + f""", ab AS ({_APART}),
parts AS (SELECT qid, block, COALESCE(SUM(a), 0) AS ta, COUNT(a) AS na, COALESCE(SUM(b), 0) AS tb, COUNT(b) AS nb, COUNT(*) AS either, COUNT(a) + COUNT(b) AS n
  FROM ab WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, SUM(ta) OVER w AS sta, SUM(na) OVER w AS sna, SUM(tb) OVER w AS stb, SUM(nb) OVER w AS snb, SUM(n) OVER w AS sn FROM parts WINDOW w AS (PARTITION BY qid)),
d AS (SELECT *, sta / sna - stb / snb AS theta, (sta - ta) / (sna - na) - (stb - tb) / (snb - nb) AS del, sn / CAST(n AS DOUBLE) AS hk FROM t),
m AS (SELECT *, SUM(theta - del) OVER w + SUM(n * del) OVER w / sn AS mean FROM d WINDOW w AS (PARTITION BY qid))
SELECT qid, ROUND(MAX(theta), 6) AS diff, ROUND(SQRT(SUM(POW(hk * theta - (hk - 1) * del - mean, 2) / (hk - 1)) / COUNT(*)), 6) AS se,
  CAST(SUM(either) AS BIGINT) AS nsnp, COUNT(*) AS blocks FROM m GROUP BY qid""")
def f4_diff_apart(spark, sf_dir):
    return rounded(fstats.f4_difference(markers(spark, sf_dir), _DIFF, overlap=False).select("qid", "diff", "se", "nsnp", "blocks"), "diff", "se")


_FIVE = [(0, 1, 2, 3, 4), (4, 3, 2, 1, 0)]


@query(o.blocks() + o.WIDE + o.sums([(f"{o.pattern('AABAB', q)} - {o.pattern('AABBA', q)}", f"{o.pattern('AABAB', q)} + {o.pattern('AABBA', q)}") for q in _FIVE]) + o.jack(o.STANDARD.format(name="score")))
def dpart_patterns(spark, sf_dir):
    return rounded(fstats.partitioned_d(markers(spark, sf_dir), _FIVE, "AABAB", "AABBA").select("qid", "score", "se", "nsnp", "blocks"), "score", "se")


@query(o.blocks() + o.WIDE + """, s AS (SELECT SUM((p2 - p0) * (p2 - p1) + c2) / SUM(2 * h2) AS f3, SUM((p0 - p3) * (p2 - p3) + c3) / SUM(2 * h2) AS s1,
  SUM((p1 - p3) * (p2 - p3) + c3) / SUM(2 * h2) AS s2, SUM((p0 - p3) * (p0 - p3) + c0 + c3) / SUM(2 * h2) AS a, SUM((p1 - p3) * (p1 - p3) + c1 + c3) / SUM(2 * h2) AS b
  FROM wide WHERE c0 + c1 + c2 + c3 + p0 + p1 + p2 + p3 + h2 IS NOT NULL)
SELECT 0 AS qid, ROUND(GREATEST(s1 / a, CASE WHEN s2 > s1 THEN (-f3 - s1) / (s2 - s1) END), 4) AS lower,
  ROUND(LEAST(1 - s2 / b, CASE WHEN s2 < s1 THEN (-f3 - s1) / (s2 - s1) END), 4) AS upper FROM s""")
def mixture_bounds(spark, sf_dir):
    out = fstats.bounds(markers(spark, sf_dir), [(0, 1, 2, 3)])
    return out.withColumns({c: F.round(c, 4) for c in ("lower", "upper")})


@query(o.ADAPTER + """SELECT a.pop AS a, b.pop AS b, ROUND(SUM(CASE WHEN a.pop = b.pop THEN 2.0 * a.n0 * a.n1 ELSE a.n0 * b.n1 + a.n1 * b.n0 END)
  / SUM(CASE WHEN a.pop = b.pop THEN a.n * (a.n - 1) ELSE a.n * b.n END), 6) AS het
  FROM moments a JOIN moments b ON a.snp = b.snp AND a.pop <= b.pop GROUP BY 1, 2""")
def het_matrix(spark, sf_dir):
    return rounded(fstats.heterozygosity_matrix(markers(spark, sf_dir), POPS), "het")


@query(o.blocks() + o.WIDE + o.sums([(f"(p{a} - p0) * (p{b} - p0) + c0" + (f" + c{a}" if a == b else ""), f"CASE WHEN p{a} + p{b} + c0{f' + c{a}' if a == b else ''} IS NOT NULL THEN 1.0 END") for i, a in enumerate(POPS[1:]) for b in POPS[1 + i :]]) + "SELECT qid, block, ROUND(top, 6) AS top, n FROM sums")
def fstats_block_means(spark, sf_dir):
    return rounded(fstats.basis_blocks(markers(spark, sf_dir), POPS).select("qid", "block", "top", "n"), "top")


@query(o.blocks() + o.WIDE + o.sums([(o.f4(1, 2, 3, 4), "CASE WHEN p1 + p2 + p3 + p4 IS NOT NULL THEN 1.0 END")]) + """,
m AS (SELECT block, top / n AS v FROM sums), c AS (SELECT block, v - AVG(v) OVER () AS d FROM m), l AS (SELECT d, LAG(d) OVER (ORDER BY block) AS e FROM c)
SELECT ROUND(SUM(d * e) / SUM(d * d), 6) AS lag1, COUNT(*) AS blocks FROM l""")
def jack_autocorr(spark, sf_dir):
    from pyspark.sql import Window

    sums = fstats.f4_vector_blocks(markers(spark, sf_dir), [1, 2], [3, 4]).select("block", (F.col("top") / F.col("n")).alias("v"))
    mean = sums.agg(F.avg("v").alias("mean"))
    # A row per block, whose number the genome bounds.
    rows = sums.join(F.broadcast(mean)).withColumn("d", F.col("v") - F.col("mean")).withColumn("e", F.lag("d").over(Window.orderBy("block")))
    return rows.agg(F.round(F.sum(F.col("d") * F.col("e")) / F.sum(F.col("d") * F.col("d")), 6).alias("lag1"), F.count("*").alias("blocks"))


@query(o.ADAPTER + "SELECT m.snp, COUNT(s.sample) AS present, (SELECT COUNT(*) FROM sample) - COUNT(s.sample) AS missing FROM marker m LEFT JOIN genotype g ON g.snp = m.snp LEFT JOIN sample s ON s.sample = g.sample GROUP BY 1")
def missing_by_snp(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return qc.missing_by_marker(d.genotype, d.sample, d.marker)


@query(o.ADAPTER + "SELECT s.sample, pop, COUNT(g) AS present, COUNT(*) FILTER (g = 1) AS hets, (SELECT COUNT(*) FROM marker) - COUNT(g) AS missing FROM sample s LEFT JOIN (SELECT * FROM genotype WHERE snp IN (SELECT snp FROM marker)) g ON g.sample = s.sample GROUP BY 1, 2")
def missing_by_sample(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return qc.missing_by_sample(d.genotype, d.sample, d.marker)


@query(o.ADAPTER + "SELECT pop, COUNT(*) AS markers, CAST(SUM(x0 + x1 + x2) AS BIGINT) AS calls, ROUND(SUM(x1) / CAST(SUM(x0 + x1 + x2) AS DOUBLE), 6) AS het_rate FROM classes GROUP BY 1")
def missing_by_pop(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return rounded(qc.missing_by_population(d.genotype, d.sample), "het_rate")


@query(o.ADAPTER + """, t AS (SELECT snp, SUM(x0 + x1 + x2) AS n, SUM(x1) / CAST(SUM(x0 + x1 + x2) AS DOUBLE) AS het, SUM(2 * x2 + x1) / CAST(2 * SUM(x0 + x1 + x2) AS DOUBLE) AS p FROM classes GROUP BY 1),
u AS (SELECT *, 2 * p * (1 - p) AS q FROM t)
SELECT snp, CAST(n AS BIGINT) AS n, ROUND(het, 6) AS het FROM u WHERE ABS(het - q) <= 2 * SQRT(q * (1 - q) / n)""")
def hw_filter(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return rounded(filters.hardy_weinberg(d.genotype, d.sample, 2.0).select("snp", "n", "het"), "het")


@query(o.ADAPTER + ", r AS (SELECT 1 + r_regionkey AS chrom, r_regionkey * 30000000 AS low, r_regionkey * 30000000 + 25000000 AS high FROM region) SELECT snp, chrom, physpos FROM marker m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.chrom = m.chrom AND m.physpos BETWEEN low AND high)")
def region_exclude(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    k = F.col("r_regionkey").cast("bigint")
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select((1 + k).alias("chrom"), (k * 30_000_000).alias("low"), (k * 30_000_000 + 25_000_000).alias("high"))
    return filters.outside_regions(d.marker, regions).select("snp", "chrom", "physpos")


@query(o.ADAPTER + ", t AS (SELECT snp, chrom, physpos // 600000 AS slot, 's' || CAST(snp * 37 % 1000 AS VARCHAR) AS name FROM marker) SELECT snp, chrom, slot AS physpos, name FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY chrom, slot ORDER BY LENGTH(name), name DESC) AS r FROM t) WHERE r = 1")
def dedup_position(spark, sf_dir):
    m = adapter.load(spark, sf_dir).marker
    coarse = m.select("snp", "chrom", F.floor(F.col("physpos") / 600_000).alias("physpos"), F.concat(F.lit("s"), (F.col("snp") * 37 % 1000).cast("string")).alias("name"))
    return filters.distinct_positions(coarse, F.col("name"))


@query(o.ADAPTER + ", t AS (SELECT snp, MIN(x0 + x1 + x2) AS fewest, COUNT(*) AS pops FROM classes GROUP BY 1) SELECT snp, fewest FROM t WHERE pops = (SELECT COUNT(DISTINCT pop) FROM sample) AND fewest >= 3")
def min_valid_pop(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return filters.min_valid(d.genotype, d.sample, 3)


@query(o.ADAPTER + "SELECT snp, chrom FROM marker WHERE chrom BETWEEN 2 AND 22 AND chrom <> 5 AND snp NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def badsnp_antijoin(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    bad = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity = 50").select(F.col("l_partkey").alias("snp"))
    return filters.without_listed(filters.chromosomes(d.marker, exclude=5).where("chrom >= 2"), bad).select("snp", "chrom")


@query(o.ADAPTER + f"SELECT code, COUNT(*) AS n FROM (SELECT {o.CODE} AS code FROM alleles a JOIN alleles2 b USING (snp)) GROUP BY 1")
def allele_match_codes(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    a, b = alleles(d).alias("a"), alleles2(d).alias("b")
    code = match_code(F.col("a.ref"), F.col("a.alt"), F.col("b.ref"), F.col("b.alt"))
    return a.join(b, "snp").groupBy(code.alias("code")).agg(F.count("*").alias("n"))


_MERGED = o.ADAPTER + f""", codes AS (SELECT snp, {o.CODE} AS code FROM alleles a JOIN alleles2 b USING (snp)),
first AS (SELECT g.* FROM genotype g JOIN codes USING (snp) WHERE code > 0),
second AS (SELECT snp, sample{{shift}} AS sample, CASE WHEN code = 2 THEN 2 - g ELSE g END AS g FROM genotype2 JOIN codes USING (snp) WHERE code > 0)
"""


@query(_MERGED.format(shift=" + 1000000") + "SELECT * FROM first UNION ALL SELECT * FROM second")
def merge_inner(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    other = adapter.second(spark, sf_dir).withColumn("sample", F.col("sample") + 1_000_000)
    return merges.merge(d.genotype, alleles(d), other, alleles2(d))


@query(_MERGED.format(shift="") + "SELECT snp, sample, COALESCE(a.g, b.g) AS g FROM first a FULL JOIN second b USING (snp, sample)")
def merge_fill(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return merges.merge(d.genotype, alleles(d), adapter.second(spark, sf_dir), alleles2(d), allow_dups=True)


@query(o.ADAPTER + "SELECT snp, sample, COALESCE(a.g, b.g) AS g FROM genotype2 a FULL JOIN genotype b USING (snp, sample)")
def multimerge_first(spark, sf_dir):
    return merges.multi_merge([adapter.second(spark, sf_dir), adapter.load(spark, sf_dir).genotype])


@query(o.ADAPTER + ", u AS (SELECT * FROM genotype UNION ALL SELECT * FROM genotype2 WHERE snp NOT IN (SELECT snp FROM genotype)) SELECT snp, sample, g FROM u WHERE sample IN (SELECT sample FROM genotype) AND sample IN (SELECT sample FROM genotype2)")
def snp_union(spark, sf_dir):
    return merges.marker_union(adapter.load(spark, sf_dir).genotype, adapter.second(spark, sf_dir))


@query(o.ADAPTER + ", o AS (SELECT snp, g AS own FROM genotype WHERE sample = 7 AND g <> 1) SELECT snp, sample, CASE WHEN own = 0 THEN 2 - g ELSE g END AS g FROM genotype JOIN o USING (snp)")
def flip_polarize(spark, sf_dir):
    return transforms.polarize(adapter.load(spark, sf_dir).genotype, 7)


@query(o.ADAPTER + ", w AS (SELECT snp FROM counts GROUP BY 1 HAVING COUNT(*) = (SELECT COUNT(DISTINCT pop) FROM sample)) SELECT snp, pop, n1 AS ref, n0 AS other FROM counts JOIN w USING (snp)")
def treemix_counts(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return qc.treemix_table(d.genotype, d.sample)


_R2 = "CASE WHEN (n * xx - x * x) * (n * yy - y * y) > 0 THEN ROUND(POW(n * xy - x * y, 2) / CAST((n * xx - x * x) * (n * yy - y * y) AS DOUBLE), 6) END"


@query(o.ADAPTER + o.pairs(BAND) + f"SELECT snp1, snp2, distance, n, {_R2} AS r2 FROM tables")
def ld_pairs_band(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    tables = linkage.pair_tables(d.genotype, d.marker, BAND)
    return rounded(linkage.r_squared(tables).select("snp1", "snp2", "distance", "n", "r2"), "r2")


@query(o.ADAPTER + o.pairs(BAND) + """, w AS (SELECT a.snp, a.p - b.p AS w FROM moments a JOIN moments b ON a.snp = b.snp AND a.pop = 1 AND b.pop = 2),
t AS (SELECT distance // 100000 AS bin, (xy - x * y / CAST(n AS DOUBLE)) / (n - 1) AS ld, a.w * b.w AS w FROM tables JOIN w a ON a.snp = snp1 JOIN w b ON b.snp = snp2 WHERE n >= 4)
SELECT bin, COUNT(*) AS pairs, ROUND(SUM(ld * w) / SUM(w * w), 6) AS regression, ROUND(SUM(ld * w) / SQRT(SUM(w * w) * SUM(ld * ld)), 6) AS correlation FROM t GROUP BY 1""")
def ld_bin_decay(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    m = counts.moments(counts.allele_counts(d.genotype, d.sample))
    weighted = d.marker.join(linkage.frequency_difference(m, 1, 2), "snp")
    tables = linkage.pair_tables(d.genotype, weighted, BAND, ("weight",))
    return rounded(linkage.decay(linkage.decay_sums(tables, 100_000)), "regression", "correlation")


@query(o.ADAPTER + """SELECT x.sample AS a, y.sample AS b, COUNT(*) AS shared, COUNT(*) FILTER (x.g = y.g) AS same FROM genotype x JOIN genotype y ON x.snp = y.snp AND x.sample < y.sample
  GROUP BY 1, 2 HAVING COUNT(*) >= 20 AND COUNT(*) FILTER (x.g = y.g) >= 0.3 * COUNT(*)""")
def dup_samples(spark, sf_dir):
    return qc.similar_samples(adapter.load(spark, sf_dir).genotype, shared=20, agree=0.3)


@query(o.ADAPTER + """, cc AS (SELECT sample, chrom, COUNT(*) AS present FROM genotype JOIN marker USING (snp) GROUP BY 1, 2), tt AS (SELECT sample, SUM(present) AS calls FROM cc GROUP BY 1),
sz AS (SELECT chrom, COUNT(*) AS size FROM marker GROUP BY 1)
SELECT sample, chrom, COALESCE(present, 0) AS present, ROUND(calls * size / CAST((SELECT COUNT(*) FROM marker) AS DOUBLE), 4) AS expected
FROM tt CROSS JOIN sz LEFT JOIN cc USING (sample, chrom) WHERE COALESCE(present, 0) * 5 <= calls * size / CAST((SELECT COUNT(*) FROM marker) AS DOUBLE) * 2""")
def chrom_dropout(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    out = qc.chromosome_dropout(d.genotype, d.marker, d.sample, share=2.5)
    return out.withColumn("expected", F.round("expected", 4))


_HYPER = "CASE WHEN {i} = 0 THEN ({n0} * ({n0} - 1)) WHEN {i} = 1 THEN 2 * {n0} * {n1} ELSE {n1} * ({n1} - 1) END / CAST(({n0} + {n1}) * ({n0} + {n1} - 1) AS DOUBLE)"


@query(o.ADAPTER + f""", a AS (SELECT * FROM counts WHERE pop = 1 AND n0 + n1 >= 2), b AS (SELECT * FROM counts WHERE pop = 2 AND n0 + n1 >= 2), i AS (SELECT UNNEST([0, 1, 2]) AS i)
SELECT x.i AS k0, y.i AS k1, ROUND(SUM({_HYPER.format(i='x.i', n0='a.n0', n1='a.n1')} * {_HYPER.format(i='y.i', n0='b.n0', n1='b.n1')}), 4) AS expected
FROM a JOIN b USING (snp) CROSS JOIN i x CROSS JOIN i y GROUP BY 1, 2""")
def spectrum_2pop(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return qc.joint_spectrum(counts.allele_counts(d.genotype, d.sample), {1: 2, 2: 2}).withColumn("expected", F.round("expected", 4))


@query(o.ADAPTER + "SELECT snp, ROUND(1 / (p * (1 - p)), 6) AS weight FROM moments WHERE pop = 4 AND p > 0 AND p < 1")
def marker_weights(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return rounded(filters.marker_weights(counts.moments(counts.allele_counts(d.genotype, d.sample)), 4), "weight")


@query(o.ADAPTER + "SELECT snp, present, (SELECT COUNT(*) FROM sample) - present AS missing FROM (SELECT snp, COUNT(*) AS present FROM genotype JOIN sample USING (sample) GROUP BY 1) WHERE (SELECT COUNT(*) FROM sample) - present <= 0.75 * (SELECT COUNT(*) FROM sample)")
def max_missing(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    return filters.max_missing(d.genotype, d.sample, 0.75)


@query(o.blocks(5_000_000) + "SELECT snp, chrom, genpos FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY block ORDER BY genpos, physpos, snp) AS r FROM blocked) WHERE r = 1")
def decimate(spark, sf_dir):
    return filters.thinned(adapter.load(spark, sf_dir).marker, 5_000_000).select("snp", "chrom", "genpos")


def queries() -> dict[str, Query]:
    from allelica.plans import converted, files, lengths, linked, models, reports, variants  # noqa: F401  they register their queries

    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


__all__ = ["jackknife", "oracle_sql", "queries"]
