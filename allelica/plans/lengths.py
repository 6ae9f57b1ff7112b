"""Queries of tree lengths and of the covariance of several statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from allelica.operators import fstats, jackknife
from allelica.plans import oracle as o
from allelica.plans.queries import QUADS, markers, query

_PROJECT = np.linalg.pinv(np.array(fstats.TREE_PATHS, dtype=float))


def _edge(k: int, q: tuple) -> str:
    """The SQL of an edge: the constant projection of six corrected squared differences."""
    pairs = [(q[i], q[j]) for i in range(4) for j in range(i + 1, 4)]
    return " + ".join(f"({w:.12f}) * ((p{a} - p{b}) * (p{a} - p{b}) - h{a} / n{a} - h{b} / n{b})" for w, (a, b) in zip(_PROJECT[k], pairs, strict=True))


def _mismatch(a: int, b: int) -> str:
    return f"(p{a} * (1 - p{b}) + p{b} * (1 - p{a}))"


_N = ", ".join(f"MAX(CASE WHEN pop = {k} THEN n END) AS n{k}" for k in range(5))
_SIZED = f", sized AS (SELECT snp, {_N} FROM moments GROUP BY 1), paired AS (SELECT * FROM wide JOIN sized USING (snp))"
_EDGES = o.sums([(_edge(k, q), f"{_mismatch(*q[:2])} * {_mismatch(*q[2:])}") for q in QUADS for k in range(5)]).replace("FROM wide", "FROM paired")


@query(o.blocks() + o.WIDE + _SIZED + _EDGES + o.jack("CAST(qid // 5 AS INTEGER) AS qid, CAST(qid % 5 AS INTEGER) AS edge, ROUND(mean, 6) + 0.0 AS length, ROUND(se, 6) AS se, blocks"))
def tree_lengths(spark, sf_dir):
    out = fstats.tree_lengths(markers(spark, sf_dir), QUADS)
    return out.select("qid", "edge", (F.round("length", 6) + 0.0).alias("length"), F.round("se", 6).alias("se"), "blocks")


_STATISTICS = fstats.three_pairings(list(range(5)))


@query(o.blocks() + o.WIDE + o.sums([(o.f4(*q), f"CASE WHEN {o.f4(*q)} IS NOT NULL THEN 1.0 END") for q in _STATISTICS]) + """,
grid AS (SELECT q.qid, b.block, COALESCE(top, 0) AS top, COALESCE(n, 0) AS n FROM (SELECT DISTINCT qid FROM sums) q CROSS JOIN (SELECT DISTINCT block FROM sums) b LEFT JOIN sums USING (qid, block)),
wt AS (SELECT block, AVG(n) AS w FROM grid GROUP BY 1),
x AS (SELECT qid, block, w, SUM(w) OVER (PARTITION BY qid) / w AS h, SUM(top) OVER (PARTITION BY qid) / SUM(n) OVER (PARTITION BY qid) AS est,
  (SUM(top) OVER (PARTITION BY qid) - top) / (SUM(n) OVER (PARTITION BY qid) - n) AS less FROM grid JOIN wt USING (block)),
m AS (SELECT *, SUM(est - less) OVER (PARTITION BY qid) + SUM(less / h) OVER (PARTITION BY qid) AS mean FROM x),
d AS (SELECT qid, block, (h * est - (h - 1) * less - mean) / SQRT(h - 1) AS d FROM m)
SELECT a.qid AS i, b.qid AS j, ROUND(1e6 * SUM(a.d * b.d) / COUNT(*), 4) + 0.0 AS cov FROM d a JOIN d b USING (block) GROUP BY 1, 2""")
def f4_covariance(spark, sf_dir):
    """i, j, cov (in millionths) of the jackknife covariance of all f4 statistics of five populations."""
    sums = fstats.d_blocks(markers(spark, sf_dir), _STATISTICS, f4mode=True)
    k = len(_STATISTICS)
    found = jackknife.covariance(sums, k)
    rows = [(i, j, float(found.cov[i, j])) for i in range(k) for j in range(k)]
    return spark.createDataFrame(rows, "i int, j int, v double").select("i", "j", (F.round(1e6 * F.col("v"), 4) + 0.0).alias("cov"))
