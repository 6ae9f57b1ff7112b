"""Numbered tuples, block sums by tuple, jackknife covariance, tree lengths and the basis against plain loops."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelica.operators import fstats, jackknife
from allelica.plans import basis
from tests.test_operators import simulated


def plain_statistics(pops):
    f2 = [(a, b, a, b) for a, b in combinations(pops, 2)]
    f3 = [(a, b, a, c) for a in pops for b, c in combinations([p for p in pops if p != a], 2)]
    return f2 + f3 + plain_pairings(pops)


def plain_pairings(pops):
    return [q for a, b, c, d in combinations(pops, 4) for q in ((a, b, c, d), (a, c, b, d), (a, d, b, c))]


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9])
def test_tuples_by_number(n):
    pops = [f"p{k}" for k in range(n)]
    for made, want in ((fstats.ThreePairings(pops), plain_pairings(pops)), (fstats.AllStatistics(pops), plain_statistics(pops))):
        assert list(made) == want and len(made) == len(want) and made[1:3] == want[1:3]
        for low in range(0, len(want), 7):
            assert [tuple(pops[i] for i in r) for r in made.take(low, min(len(want), low + 11))] == want[low : low + 11]


def test_many_tuples_are_not_listed():
    many = fstats.ThreePairings(range(300))
    assert len(many) == 3 * 330_791_175 and many[len(many) - 1] == (296, 299, 297, 298) and many[0] == (0, 1, 2, 3)


def plain_sums(markers, quads, fn):
    """{(qid, block): (sum, n)} marker by marker; fn returns None where unknown."""
    out = {}
    for r in markers.collect():
        for k, q in enumerate(quads):
            if all(x in r.m for x in q) and (v := fn([r.m[x] for x in q], q)) is not None:
                s, n = out.get((k, r.block), (0.0, 0))
                out[k, r.block] = (s + v, n + 1)
    return out


@pytest.mark.parametrize("cells", [50, 2_000_000])
def test_sums_of_batches(spark, cells):
    m = simulated(spark)
    m = m.withColumn("m", F.map_filter("m", lambda p, x: F.pmod(F.xxhash64("snp", p), F.lit(5)) > 0))  # some populations lack data
    quads = [("O", "A", "B", "C"), ("A", "B", "A", "B"), ("A", "X", "C", "A"), ("O", "O", "B", "C")]

    def general(x, q):
        v = (x[0].p - x[1].p) * (x[2].p - x[3].p)
        for i, j, sign in ((0, 2, 1), (1, 3, 1), (0, 3, -1), (1, 2, -1)):
            v += sign * x[i].c if q[i] == q[j] else 0
        return v

    got = {(r.qid, r.block): (r.top, r.n) for r in fstats.tuple_sums(m, quads, ["top", "bot"], fstats._general, "pc", cells).collect()}
    want = plain_sums(m, quads, general)
    assert got.keys() == want.keys()
    assert all(got[k][0] == pytest.approx(v[0], abs=1e-12) and got[k][1] == v[1] for k, v in want.items())
    whole = {r.snp for r in m.collect() if all(p in r.m for q in quads for p in q)}
    some = plain_sums(m.where(F.col("snp").isin(list(whole))), quads, general)
    got = {(r.qid, r.block): (r.top, r.n) for r in fstats.tuple_sums(m, quads, ["top", "bot"], fstats._general, "pc", cells, complete=True).collect()}
    assert got.keys() == some.keys() and all(got[k][0] == pytest.approx(v[0], abs=1e-12) and got[k][1] == v[1] for k, v in some.items())
    names = {r.qid: (r.q0, r.q1, r.q2, r.q3) for r in fstats.populations_of(spark, quads).collect()}
    assert names == dict(enumerate(quads))


def test_covariance_of_blocks(spark):
    rng = np.random.default_rng(4)
    n = rng.integers(1, 50, (30, 4)).astype(float)
    n[3, 1] = n[7] = 0  # a statistic without markers in a block, and a block without any
    top = n * (0.3 + rng.normal(0, 0.01, (30, 4)) + rng.normal(0, 0.02, (30, 1)))
    rows = [(q, b, float(top[b, q]), float(n[b, q])) for b in range(30) for q in range(4) if n[b, q]]
    got = jackknife.covariance(spark.createDataFrame(rows, "qid int, block bigint, top double, n double").repartition(5), 4)
    full = top.sum(axis=0) / n.sum(axis=0)
    weights = n.mean(axis=1)
    mean, cov = jackknife.vector((top.sum(axis=0) - top) / (n.sum(axis=0) - n), full, weights)
    assert got.mean == pytest.approx(mean, rel=1e-10) and got.full == pytest.approx(full) and got.blocks == 29
    assert got.cov == pytest.approx(cov, rel=1e-8, abs=1e-14) and got.effective == pytest.approx(jackknife.effective_blocks(weights))


def test_tree_lengths_of_an_exact_tree(spark):
    """Six distances that a tree makes give back its edges."""
    edges = np.array([0.02, 0.05, 0.01, 0.03, 0.04])
    project = np.linalg.pinv(np.array(fstats.TREE_PATHS, dtype=float))
    assert project @ (np.array(fstats.TREE_PATHS) @ edges) == pytest.approx(edges)
    m = simulated(spark)
    got = {r.edge: r for r in fstats.tree_lengths(m, [("O", "A", "B", "C")]).collect()}
    pops, top, bot = ("O", "A", "B", "C"), np.zeros(6), 0.0
    for r in m.collect():
        x = [r.m[p] for p in pops]
        top += [(x[i].p - x[j].p) ** 2 - x[i].h / x[i].n - x[j].h / x[j].n for i, j in combinations(range(4), 2)]
        mis = lambda a, b: a.p * (1 - b.p) + b.p * (1 - a.p)
        bot += mis(x[0], x[1]) * mis(x[2], x[3])
    want = project @ top / bot
    assert len(got) == 5 and all(got[k].length == pytest.approx(want[k], abs=4 * got[k].se + 1e-9) and got[k].se > 0 for k in range(5))


def test_basis_is_least_squares_of_all_statistics(spark):
    m, pops = simulated(spark), ["O", "A", "B", "C", "X"]
    quads = plain_statistics(pops)
    rows = fstats.general_blocks(m, quads).collect()
    blocks = sorted({r.block for r in rows})
    top, n = np.zeros((len(blocks), len(quads))), np.zeros((len(blocks), len(quads)))
    for r in rows:
        top[blocks.index(r.block), r.qid], n[blocks.index(r.block), r.qid] = r.top, r.n
    full, less = top.sum(axis=0) / n.sum(axis=0), (top.sum(axis=0) - top) / (n.sum(axis=0) - n)
    var = np.array([jackknife.vector(less[:, [k]], full[[k]], n[:, k])[1][0, 0] for k in range(len(quads))])
    root = np.sqrt((var * len(blocks) + var.mean()) / (len(blocks) + 1))
    design = np.array([basis.coefficients(q, pops) for q in quads])
    solve = np.linalg.pinv(design / root[:, None])
    mean, cov = jackknife.vector((solve @ (less / root).T).T, solve @ (full / root), n.mean(axis=1))
    got = basis.fit(m, pops)
    assert got.mean == pytest.approx(mean, rel=1e-6, abs=1e-10) and got.cov == pytest.approx(cov, rel=1e-5, abs=1e-12)
    places, signs = basis._design(fstats.AllStatistics(pops).take(0, len(quads)), design.shape[1])
    made = np.zeros(design.shape)
    np.add.at(made, (np.repeat(np.arange(len(quads)), 4), places.ravel()), signs.ravel())
    assert (made == design).all()
