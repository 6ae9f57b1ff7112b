"""Registered queries that end in small dense algebra on block sums: rank test, admixture weights, basis, decay.

Their block sums come from the operators and are held against SQL elsewhere; the algebra has no SQL text and is
tested against closed forms and plain loops.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from allelica.operators import counts, fstats, jackknife, linkage
from allelica.plans import basis, numeric
from allelica.plans.queries import BAND, POPS, markers, query
from allelica.sources import adapter

LEFT, RIGHT = [0, 1], [2, 3, 4]


@query(None)
def rank_test(spark, sf_dir):
    """rank, dof, chisq, tail of f4(L0, Li; R0, Rj) for every rank."""
    m, n = len(LEFT) - 1, len(RIGHT) - 1
    found = jackknife.covariance(fstats.f4_vector_blocks(markers(spark, sf_dir), LEFT, RIGHT), m * n)
    x, cov = found.mean.reshape(m, n), numeric.shrink(found.cov, found.effective)
    tests = [numeric.rank_test(x, cov, r) for r in range(min(x.shape) + 1)]
    return spark.createDataFrame([(t.rank, t.dof, round(t.chi_square, 4), round(t.tail, 4)) for t in tests], "rank int, dof int, chisq double, tail double")


@query(None)
def admixture_weights(spark, sf_dir):
    """source, weight, se, chisq, dof, tail of population 0 as a mixture of 1 and 2 with 3 and 4 on the right."""
    x, cov, deleted, weights = numeric.f4_matrix(fstats.f4_vector_blocks(markers(spark, sf_dir), [0, 1, 2], [3, 4]), 2, 1)
    cov = numeric.shrink(cov, jackknife.effective_blocks(weights))
    w, score, dof = numeric.admixture_weights(x, cov)
    se, _ = numeric.weight_errors(deleted, w, cov, weights)
    tail = numeric.chi_square_tail(score, dof)
    return spark.createDataFrame([(s, round(float(a), 5), round(float(e), 5), round(score, 4), dof, round(tail, 4)) for s, a, e in zip((1, 2), w, se, strict=True)], "source int, weight double, se double, chisq double, dof int, tail double")


@query(None)
def admixture_submodels(spark, sf_dir):
    """pattern, dof, chisq, tail, feasible of all patterns of sources fixed at zero."""
    x, cov, _, weights = numeric.f4_matrix(fstats.f4_vector_blocks(markers(spark, sf_dir), [0, 1, 2], [3, 4]), 2, 1)
    found = numeric.sub_models(x, numeric.shrink(cov, jackknife.effective_blocks(weights)))
    return spark.createDataFrame([(m["pattern"], m["dof"], round(m["chisq"], 4), round(m["tail"], 4), m["feasible"]) for m in found], "pattern string, dof int, chisq double, tail double, feasible boolean")


@query(None)
def source_mixture(spark, sf_dir):
    """source, coefficient, se of population 0 as a mixture of the others, from f(target, b; target, c)."""
    pops = POPS
    quads = [(pops[0], b, pops[0], c) for i, b in enumerate(pops[1:]) for c in pops[1 + i :]]
    found = numeric.mixture(fstats.complete_blocks(markers(spark, sf_dir), quads), len(pops) - 1)
    return spark.createDataFrame([(int(p), round(float(a), 5), round(float(e), 5)) for p, a, e in zip(pops[1:], *found, strict=True)], "source int, coefficient double, se double")


@query(None)
def fstats_basis(spark, sf_dir):
    """a, b, mean, se of the basis fitted to all f-statistics."""
    b = basis.fit(markers(spark, sf_dir), POPS)
    rows = [(int(x), int(y), round(float(m), 7), round(float(np.sqrt(b.cov[k, k])), 7)) for k, ((x, y), m) in enumerate(zip(basis.pairs(POPS), b.mean, strict=True))]
    return spark.createDataFrame(rows, "a int, b int, mean double, se double")


@query(None)
def fstats_evaluated(spark, sf_dir):
    """qid, f, se, z of f4 lines from the basis, with the joint T2 and its degrees of freedom."""
    found = basis.fit(markers(spark, sf_dir), POPS)
    quads = [(1, 2, 3, 4), (0, 1, 2, 3), (0, 2, 1, 4)]
    f, cov = found.evaluate(quads)
    t2, dof = basis.joint_test(f, cov)
    se = np.sqrt(np.diag(cov))
    return spark.createDataFrame([(k, round(float(v), 7), round(float(s), 7), round(float(v / s), 4), round(t2, 4), dof) for k, (v, s) in enumerate(zip(f, se, strict=True))], "qid int, f double, se double, z double, t2 double, dof int")


@query(None)
def fourier_jackknife(spark, sf_dir):
    """f4, se, rho by the Fourier jackknife over blocks in genome order."""
    sums = fstats.f4_vector_blocks(markers(spark, sf_dir), [1, 2], [3, 4]).orderBy("block").select("top", "n").toPandas()
    top, n = sums["top"].to_numpy(float), sums["n"].to_numpy(float)
    est, se, rho = jackknife.fourier(top.sum() / n.sum(), (top.sum() - top) / (n.sum() - n), n)
    return spark.createDataFrame([(round(est, 6), round(se, 6), round(rho, 6))], "f4 double, se double, rho double")


@query(None)
def decay_dates(spark, sf_dir):
    """left_out (null: none), generations, and the error of the whole from dates without each chromosome; null where too
    few pairs have enough common samples for a curve."""
    d = adapter.load(spark, sf_dir)
    m = counts.moments(counts.allele_counts(d.genotype, d.sample))
    weighted = d.marker.join(linkage.frequency_difference(m, 1, 2), "snp")
    found = linkage.decay_sums(linkage.pair_tables(d.genotype, weighted, BAND, ("weight",)), 100_000)
    # A row for each bin and chromosome, from one count of the pairs.
    held = found.collect()
    sums = spark.createDataFrame(held, found.schema)
    own, whole = linkage.decay_without_each(sums).toPandas(), linkage.decay(sums).toPandas()
    sizes = d.marker.groupBy("chrom").count().toPandas().set_index("chrom")["count"]
    rows, se = numeric.dates(whole, own, sizes, 100_000 * 1e-7, sorted({r.chrom for r in held}))
    return spark.createDataFrame([(k, v, se) for k, v in rows], "left_out bigint, generations double, se double")
