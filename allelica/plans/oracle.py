"""DuckDB texts of the queries, written apart from the DataFrame code."""

from __future__ import annotations

ADAPTER = """
WITH RECURSIVE genotype AS (
  SELECT l_partkey AS snp, l_suppkey AS sample, MIN(CAST(l_quantity AS BIGINT) % 3) AS g FROM lineitem GROUP BY 1, 2),
genotype2 AS (
  SELECT l_partkey + 50 AS snp, l_suppkey + 3 AS sample, MAX(l_orderkey % 3) AS g FROM lineitem GROUP BY 1, 2),
sample AS (
  SELECT s_suppkey AS sample, CAST(n_regionkey AS BIGINT) AS pop, CASE WHEN s_suppkey % 2 = 1 THEN 'M' ELSE 'F' END AS sex,
    CAST(s_nationkey % 2 AS BIGINT) AS affected FROM supplier JOIN nation ON s_nationkey = n_nationkey),
marker AS (
  SELECT p_partkey AS snp, 1 + CAST(FLOOR(p_partkey * 22 / CAST((SELECT COUNT(*) FROM part) AS DOUBLE)) AS BIGINT) AS chrom,
    p_partkey * 200000 + ((p_partkey * 7919) % 10000) * 10 AS physpos,
    CAST(FLOOR((p_partkey * 200000 + ((p_partkey * 7919) % 10000) * 10) / 10) AS BIGINT) AS genpos FROM part),
alleles AS (
  SELECT snp, ['A','C','G','T'][1 + snp % 4] AS ref, ['A','C','G','T'][1 + (snp + 1 + snp % 2) % 4] AS alt FROM marker),
alleles2 AS (
  SELECT snp, CASE WHEN snp % 5 = 0 THEN alt WHEN snp % 5 = 1 THEN TRANSLATE(ref, 'ACGT', 'TGCA') ELSE ref END AS ref,
    CASE WHEN snp % 5 = 0 THEN ref WHEN snp % 5 = 1 THEN TRANSLATE(alt, 'ACGT', 'TGCA') WHEN snp % 5 = 2 THEN ref ELSE alt END AS alt FROM alleles),
counts AS (
  SELECT snp, pop, CAST(SUM(2 - g) AS BIGINT) AS n0, CAST(SUM(g) AS BIGINT) AS n1 FROM genotype JOIN sample USING (sample) GROUP BY 1, 2),
classes AS (
  SELECT snp, pop, COUNT(*) FILTER (g = 0) AS x0, COUNT(*) FILTER (g = 1) AS x1, COUNT(*) FILTER (g = 2) AS x2
  FROM genotype JOIN sample USING (sample) GROUP BY 1, 2),
mom0 AS (
  SELECT snp, pop, n0, n1, n0 + n1 AS n, n1 / CAST(n0 + n1 AS DOUBLE) AS p,
    CASE WHEN n0 + n1 >= 2 THEN n0 * n1 / CAST((n0 + n1) * (n0 + n1 - 1) AS DOUBLE) END AS h FROM counts),
moments AS (SELECT *, p - h - p * p AS c FROM mom0)
"""

BLOCKS = """,
next_start AS (
  SELECT snp, chrom, genpos, MIN(genpos) OVER (PARTITION BY chrom ORDER BY genpos RANGE BETWEEN {size} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM marker),
starts AS (
  SELECT chrom, MIN(genpos) AS s FROM marker GROUP BY chrom
  UNION
  SELECT n.chrom, n.nxt FROM starts t JOIN next_start n ON n.chrom = t.chrom AND n.genpos = t.s WHERE n.nxt IS NOT NULL),
numbered AS (
  SELECT chrom, s, LEAD(s) OVER (PARTITION BY chrom ORDER BY s) AS e, ROW_NUMBER() OVER (ORDER BY chrom, s) AS block FROM starts),
blocked AS (
  SELECT m.*, b.block FROM marker m JOIN numbered b ON m.chrom = b.chrom AND m.genpos >= b.s AND (b.e IS NULL OR m.genpos < b.e))
"""

WIDE = """,
wide AS (
  SELECT m.snp, b.block, {columns} FROM moments m JOIN blocked b USING (snp) GROUP BY 1, 2)
""".replace(
    "{columns}", ", ".join(f"MAX(CASE WHEN pop = {k} THEN {c} END) AS {c}{k}" for k in range(5) for c in ("p", "h", "c", "n", "n0_", "n1_")).replace("THEN n0_ END", "THEN n0 END").replace("THEN n1_ END", "THEN n1 END")
)


def blocks(size: int = 500_000) -> str:
    return ADAPTER + BLOCKS.format(size=size)


def jack(select: str, full: str = "st / sb", without: str = "(st - top) / (sb - bot)") -> str:
    """Jackknife over a CTE ``sums`` (qid, block, top, bot, n); ``select`` names the columns of the result."""
    return f""",
tot AS (SELECT *, SUM(top) OVER w AS st, SUM(bot) OVER w AS sb, SUM(n) OVER w AS sn, SUM(n) OVER w / CAST(n AS DOUBLE) AS hk
  FROM sums WINDOW w AS (PARTITION BY qid)),
del AS (SELECT *, {full} AS theta, {without} AS del FROM tot),
mid AS (SELECT *, SUM(theta - del) OVER w + SUM(n * del) OVER w / sn AS mean FROM del WINDOW w AS (PARTITION BY qid)),
jk AS (SELECT qid, MAX(theta) AS est, MAX(mean) AS mean, SQRT(SUM(POW(hk * theta - (hk - 1) * del - mean, 2) / (hk - 1)) / COUNT(*)) AS se,
  COUNT(*) AS blocks FROM mid GROUP BY qid),
tn AS (SELECT qid, CAST(SUM(n) AS BIGINT) AS nsnp FROM sums GROUP BY qid)
SELECT {select} FROM jk JOIN tn USING (qid)"""


def sums(parts: list[tuple[str, str]], more: str = "") -> str:
    """CTE sums from (top, bot) expressions over wide, one per tuple."""
    rows = " UNION ALL ".join(f"SELECT {k} AS qid, block, {t} AS top, CAST({b} AS DOUBLE) AS bot FROM wide" for k, (t, b) in enumerate(parts))
    return f""",
terms AS ({rows}),
sums AS (SELECT qid, block, SUM(top) AS top, SUM(bot) AS bot, COUNT(*) AS n{more} FROM terms WHERE top IS NOT NULL AND bot IS NOT NULL GROUP BY 1, 2)"""


def f4(a: int, b: int, c: int, d: int) -> str:
    return f"(p{a} - p{b}) * (p{c} - p{d})"


STANDARD = "qid, ROUND(est, 6) AS {name}, ROUND(se, 6) AS se, nsnp, blocks"


def dstat_parts(quads: list[tuple], f4mode: bool = False) -> list[tuple[str, str]]:
    one = lambda q: f"((p{q[0]} * (1 - p{q[1]}) + p{q[1]} * (1 - p{q[0]})) * (p{q[2]} * (1 - p{q[3]}) + p{q[3]} * (1 - p{q[2]})))"
    return [(f4(*q), f"CASE WHEN {f4(*q)} IS NOT NULL THEN 1.0 END" if f4mode else one(q)) for q in quads]


def pattern(text: str, pops: tuple) -> str:
    one = " * ".join(f"p{k}" if c == "A" else f"(1 - p{k})" for c, k in zip(text, pops, strict=True))
    other = " * ".join(f"(1 - p{k})" if c == "A" else f"p{k}" for c, k in zip(text, pops, strict=True))
    return f"({one} + {other})"


CODE = """CASE WHEN a.ref IN ('N','0') OR a.alt IN ('N','0') OR b.ref IN ('N','0') OR b.alt IN ('N','0') THEN -1
  WHEN TRANSLATE(a.ref, 'ACGT', 'TGCA') = a.alt AND a.ref <> 'X' THEN -2
  WHEN a.ref = b.ref AND a.alt = b.alt THEN 1 WHEN a.ref = b.alt AND a.alt = b.ref THEN 2
  WHEN a.ref = TRANSLATE(b.ref, 'ACGT', 'TGCA') AND a.alt = TRANSLATE(b.alt, 'ACGT', 'TGCA') THEN 1
  WHEN a.ref = TRANSLATE(b.alt, 'ACGT', 'TGCA') AND a.alt = TRANSLATE(b.ref, 'ACGT', 'TGCA') THEN 2 ELSE 0 END"""


def pairs(most: int) -> str:
    return f""",
pairs AS (SELECT a.snp AS snp1, b.snp AS snp2, a.chrom, b.genpos - a.genpos AS distance FROM marker a JOIN marker b
  ON a.chrom = b.chrom AND b.genpos > a.genpos AND b.genpos - a.genpos < {most}),
tables AS (SELECT snp1, snp2, chrom, distance, COUNT(*) AS n, SUM(x.g) AS x, SUM(y.g) AS y, SUM(x.g * x.g) AS xx, SUM(y.g * y.g) AS yy, SUM(x.g * y.g) AS xy
  FROM pairs JOIN genotype x ON x.snp = snp1 JOIN genotype y ON y.snp = snp2 AND y.sample = x.sample GROUP BY 1, 2, 3, 4)"""


_HYPER = "CASE WHEN {i} = 0 THEN ({n0} * ({n0} - 1)) WHEN {i} = 1 THEN 2 * {n0} * {n1} ELSE {n1} * ({n1} - 1) END / CAST(({n0} + {n1}) * ({n0} + {n1} - 1) AS DOUBLE)"

#: ``sums`` of the configurations of two alleles of population 1 and two of population 2, numbered.
SPECTRUM = (
    blocks() + f""", a AS (SELECT * FROM counts WHERE pop = 1 AND n0 + n1 >= 2), b AS (SELECT * FROM counts WHERE pop = 2 AND n0 + n1 >= 2), i AS (SELECT UNNEST([0, 1, 2]) AS i),
c AS (SELECT x.i * 3 + y.i AS qid, block, SUM({_HYPER.format(i='x.i', n0='a.n0', n1='a.n1')} * {_HYPER.format(i='y.i', n0='b.n0', n1='b.n1')}) AS top
  FROM a JOIN b USING (snp) JOIN blocked USING (snp) CROSS JOIN i x CROSS JOIN i y GROUP BY 1, 2),
sums AS (SELECT *, SUM(top) OVER (PARTITION BY block) AS bot, SUM(top) OVER (PARTITION BY block) AS n FROM c)"""
)
