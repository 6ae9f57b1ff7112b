"""Queries of linkage by haplotype EM, score decay and interaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelica.operators import counts, linkage, tiles
from allelica.plans import oracle as o
from allelica.plans.queries import BAND, query, rounded
from allelica.sources import adapter

_CELLS = ", ".join(f"COUNT(*) FILTER (x.g = {k // 3} AND y.g = {k % 3}) AS n{k}" for k in range(9))
_ALL = ", ".join(f"n{k}" for k in range(9))
_TOTAL = " + ".join(f"n{k}" for k in range(9))
_PROBABILITIES = ("p0 * p0", "2 * p0 * p1", "p1 * p1", "2 * p0 * p2", "2 * (p0 * p3 + p1 * p2)", "2 * p1 * p3", "p2 * p2", "2 * p2 * p3", "p3 * p3")
_LIKE = " + ".join(f"n{k} * LN({p} + 1e-20)" for k, p in enumerate(_PROBABILITIES))
_BOTH = "2 * (p0 * p3 + p1 * p2) + 1e-20"
_NEXT = ", ".join(f"({known} + n4 * 2 * {share} / ({_BOTH})) / (2 * ({_TOTAL})) AS p{k}" for k, (known, share) in enumerate((("2 * n0 + n1 + n3", "p0 * p3"), ("2 * n2 + n1 + n5", "p1 * p2"), ("2 * n6 + n3 + n7", "p1 * p2"), ("2 * n8 + n5 + n7", "p0 * p3"))))


def em(source: str, keys: str) -> str:
    """CTEs that end in ``fit``: the keys, ratio, z, dprime and n of tables ``source`` (keys, n0 ... n8), by at most ten
    steps of a recursion."""
    return f""",
few AS (SELECT {keys}, {_ALL}, (n3 + n4 + n5 + 2 * (n6 + n7 + n8)) / (2.0::DOUBLE * ({_TOTAL})) AS a, (n1 + n4 + n7 + 2 * (n2 + n5 + n8)) / (2.0::DOUBLE * ({_TOTAL})) AS b FROM {source} WHERE {_TOTAL} >= 3),
apart AS (SELECT *, (1 - a) * (1 - b) AS p0, (1 - a) * b AS p1, a * (1 - b) AS p2, a * b AS p3 FROM few),
based AS (SELECT *, p0 AS chance, {_LIKE} AS base FROM apart),
em AS (SELECT {keys}, {_ALL}, chance, base, p0, p1, p2, p3, -1e40::DOUBLE AS ratio, TRUE AS go, 0 AS step FROM based
  UNION ALL SELECT {keys}, {_ALL}, chance, base, {_NEXT}, {_LIKE} - base, {_LIKE} - base >= ratio + 0.001, step + 1 FROM em WHERE go AND step < 10),
done AS (SELECT *, p0 + p1 AS pa, p0 + p2 AS pb FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY step DESC) AS r FROM em) WHERE r = 1),
d AS (SELECT *, CASE WHEN p0 < pa * pb THEN LEAST(pa * pb, (1 - pa) * (1 - pb)) ELSE LEAST(pa * (1 - pb), (1 - pa) * pb) END AS most FROM done),
fit AS (SELECT {keys}, {_TOTAL} AS n, 2 * ratio AS ratio, SQRT(GREATEST(2 * ratio, 0)) * CASE WHEN p0 < chance THEN -1 ELSE 1 END AS z,
  CASE WHEN most > 1e-12 THEN LEAST(ABS(p0 - pa * pb) / most, 1) ELSE 0 END AS dprime FROM d)"""


_TABLES = f""",
pairs AS (SELECT a.snp AS snp1, b.snp AS snp2, a.chrom, b.genpos - a.genpos AS distance FROM marker a JOIN marker b
  ON a.chrom = b.chrom AND b.genpos > a.genpos AND b.genpos - a.genpos < {BAND})"""
_PLAIN = _TABLES + f""",
cells AS (SELECT snp1, snp2, {_CELLS} FROM pairs JOIN genotype x ON x.snp = snp1 JOIN genotype y ON y.snp = snp2 AND y.sample = x.sample GROUP BY 1, 2)"""


@query(o.ADAPTER + _PLAIN + em("cells", "snp1, snp2") + """
SELECT snp1, snp2, CAST(n AS BIGINT) AS n, ROUND(ratio, 4) + 0.0 AS ratio, ROUND(z, 4) + 0.0 AS z, ROUND(dprime, 4) AS dprime FROM fit""")
def ld_em_band(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    found = linkage.linkage_em(tiles.pair_cells(d.genotype, d.marker, BAND)).where("ratio is not null")
    n = F.aggregate("cells0", F.lit(0).cast("bigint"), lambda s, x: s + x)
    plain = lambda c: (F.round(c, 4) + 0.0).alias(c)  # noqa: E731  no negative zero
    return found.select("snp1", "snp2", n.alias("n"), plain("ratio"), plain("z"), plain("dprime"))


#: Of the test tables' few calls: parents are populations 1 and 2, the mixed samples all others.
_PARENT_CALLS, _LEAST, _LINKED = 3, 2, 3.0
_MINOR = "LEAST({c}, 2 * ({t}) - ({c}))"
_C1, _C2 = "n3 + n4 + n5 + 2 * (n6 + n7 + n8)", "n1 + n4 + n7 + 2 * (n2 + n5 + n8)"


@query(o.ADAPTER + _TABLES + f""", grp AS (SELECT sample, CASE pop WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS grp FROM sample),
call AS (SELECT g.*, grp FROM genotype g JOIN grp USING (sample)),
cells AS (SELECT snp1, snp2, chrom, distance, x.grp AS grp, {_CELLS} FROM pairs JOIN call x ON x.snp = snp1 JOIN call y ON y.snp = snp2 AND y.sample = x.sample GROUP BY ALL)"""
       + em("cells", "snp1, snp2, distance, grp") + f""",
w AS (SELECT a.snp, a.p - b.p AS w FROM moments a JOIN moments b ON a.snp = b.snp AND a.pop = 1 AND b.pop = 2),
enough AS (SELECT snp1, snp2, grp FROM cells WHERE {_TOTAL} >= CASE grp WHEN 0 THEN 4 ELSE {_PARENT_CALLS} END
  AND (grp > 0 OR (LEAST({_C1}, 2 * ({_TOTAL}) - ({_C1})) >= {_LEAST} AND LEAST({_C2}, 2 * ({_TOTAL}) - ({_C2})) >= {_LEAST}))),
good AS (SELECT snp1, snp2 FROM enough LEFT JOIN fit USING (snp1, snp2, grp) WHERE grp = 0 OR COALESCE(ratio, -1) < {_LINKED} GROUP BY 1, 2 HAVING COUNT(*) = 3),
t AS (SELECT distance // 100000 AS bin, z, a.w * b.w AS w FROM good JOIN fit USING (snp1, snp2) JOIN w a ON a.snp = snp1 JOIN w b ON b.snp = snp2 WHERE grp = 0 AND a.w <> 0 AND b.w <> 0)
SELECT bin, COUNT(*) AS pairs, ROUND(SUM(w * z) / SQRT(SUM(w * w)), 4) + 0.0 AS z, ROUND(SUM(w * z) / SUM(w * w), 4) + 0.0 AS regression, ROUND(SUM(w * z) / SQRT(SUM(w * w) * SUM(z * z)), 4) + 0.0 AS correlation FROM t GROUP BY 1""")
def rolloff_z(spark, sf_dir):
    d = adapter.load(spark, sf_dir)
    groups = d.sample.select("sample", F.when(F.col("pop") == 1, 1).when(F.col("pop") == 2, 2).otherwise(0).alias("grp"))
    m = counts.moments(counts.allele_counts(d.genotype, d.sample))
    weighted = d.marker.join(linkage.frequency_difference(m, 1, 2), "snp")
    pairs = tiles.pair_cells(d.genotype, weighted.where("weight <> 0"), BAND, groups, carry=("weight",))
    out = linkage.score_decay(pairs, None, 100_000, _LEAST, (1, 2), _LINKED, _PARENT_CALLS)
    return out.select("bin", "pairs", *[(F.round(c, 4) + 0.0).alias(c) for c in ("z", "regression", "correlation")])


@query(None)
def epistasis_band(spark, sf_dir):
    """Tested against plain Newton steps: a logistic fit has no closed form."""
    d = adapter.load(spark, sf_dir)
    groups = d.sample.select("sample", F.col("affected").cast("int").alias("grp"))
    found = linkage.epistasis(tiles.pair_cells(d.genotype, d.marker, BAND // 4, groups))
    return rounded(found.select("snp1", "snp2", "distance", "interaction"), "interaction")
