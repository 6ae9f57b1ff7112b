"""Pruning, similar samples, correlations and small algebra against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelica.functions.alleles import pair_class
from allelica.operators import filters, fstats, jackknife, linkage, merges, qc
from allelica.plans import basis, models, numeric
from tests.test_operators import calls, simulated


def sparse(spark, samples=70, snps=60, seed=3):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, (snps, samples))
    g[1::4] = np.where(rng.random((len(g[1::4]), samples)) < 0.9, g[::4][: len(g[1::4])], g[1::4])
    held = rng.random((snps, samples)) < 0.8
    rows = [(i, j, int(g[i, j])) for i in range(snps) for j in range(samples) if held[i, j]]
    return np.where(held, g, -1), spark.createDataFrame(rows, "snp bigint, sample bigint, g bigint")


def test_pair_tables(spark):
    g, df = sparse(spark)
    m = spark.createDataFrame([(k, 1, 10 * k) for k in range(len(g))], "snp bigint, chrom bigint, genpos bigint")
    for r in linkage.pair_tables(df, m, 35).collect():
        a, b = g[r.snp1], g[r.snp2]
        both = (a >= 0) & (b >= 0)
        a, b = a[both], b[both]
        assert (r.n, r.x, r.y, r.xx, r.yy, r.xy) == (len(a), a.sum(), b.sum(), (a * a).sum(), (b * b).sum(), (a * b).sum())


def test_similar_samples_are_all_pairs(spark):
    g, df = sparse(spark)
    want = {}
    for a in range(g.shape[1]):
        for b in range(a + 1, g.shape[1]):
            both = (g[:, a] >= 0) & (g[:, b] >= 0)
            same = int((g[both, a] == g[both, b]).sum())
            if both.sum() >= 30 and same >= 0.4 * both.sum():
                want[a, b] = (int(both.sum()), same)
    for tile, chunk in ((512, 16_384), (20, 30)):
        got = qc.similar_samples(df, 30, 0.4, tile, chunk)
        assert {(min(r.a, r.b), max(r.a, r.b)): (r.shared, r.same) for r in got.collect()} == want


def test_similar_samples_of_few_calls(spark, monkeypatch):
    """Markers of few calls are counted by their calls, full ones by tiles; both add up."""
    rng = np.random.default_rng(8)
    rows = [(m, 7 * int(s), int(rng.integers(0, 3))) for m in range(60) for s in rng.choice(400, 12 if m % 20 else 300, replace=False) if s // 20 == m % 20 or not m % 20 or s < 40]
    df = spark.createDataFrame(rows, "snp bigint, sample bigint, g bigint")
    held, want = {(m, s): g for m, s, g in rows}, {}
    names = sorted({s for _, s, _ in rows})
    for (m, s), g in held.items():
        for t in names:
            if t > s and (m, t) in held:
                n, same = want.get((s, t), (0, 0))
                want[s, t] = (n + 1, same + (held[m, t] == g))
    some = lambda out: {(r.a, r.b): (r.shared, r.same) for r in out.collect()}
    monkeypatch.setattr(qc, "PAIRS", 100)
    assert some(qc.similar_samples(df, 2, 0.5, 100, 2)) == {k: v for k, v in want.items() if v[0] >= 2 and v[1] >= 0.5 * v[0]}
    # No tiles of all samples by all others where each marker has few calls.
    monkeypatch.setattr(qc, "_pairs_of_tiles", None)
    thin = spark.createDataFrame([r for r in rows if r[0] % 20], "snp bigint, sample bigint, g bigint").unionAll(spark.range(1, 4000).selectExpr("1000 + id", "100000 + id", "0"))
    assert some(qc.similar_samples(thin, 2, 0.0)) == some(qc.compare_samples(thin, spark.createDataFrame(list(want), "a bigint, b bigint")).where("shared >= 2"))


def test_pruning_walks_along_the_chromosome(spark):
    rng = np.random.default_rng(6)
    n = 80
    score = rng.permutation(n)
    pairs = sorted({(i, j) for i in range(n - 1) for j in rng.integers(i + 1, min(n, i + 6), 2) if rng.random() < 0.5})
    gone = set()
    for i in range(n):
        if i in gone:
            continue
        bad = [j for a, j in pairs if a == i and j not in gone]
        if bad and max(score[j] for j in bad) > score[i]:
            gone.add(i)
        else:
            gone.update(bad)
    scores = spark.createDataFrame([(k, 1, k, int(score[k])) for k in range(n)], "snp bigint, chrom bigint, ord bigint, score bigint")
    linked = spark.createDataFrame([(i, int(j), 1) for i, j in pairs], "snp1 bigint, snp2 bigint, chrom bigint")
    assert {r.snp for r in filters.linked_prune(scores, linked).collect()} == set(range(n)) - gone
    assert {r.snp for r in filters.linked_prune(scores, linked.selectExpr("snp2 snp1", "snp1 snp2", "chrom")).collect()} == set(range(n)) - gone


def test_pruning_of_chromosomes_and_of_one_place(spark):
    """Chromosomes apart; markers of one place are ordered by snp."""
    rng = np.random.default_rng(16)
    rows, pairs, gone = [], [], set()
    for c in (1, 2):
        at = np.sort(rng.integers(0, 300, 200))
        score = rng.integers(0, 9, 200)
        ids = rng.permutation(200) + 1000 * c
        own = sorted(zip(at.tolist(), ids.tolist(), score.tolist(), strict=True))
        rows += [(s, c, o, v) for o, s, v in own]
        linked = {(i, j) for i in range(199) for j in range(i + 1, 200) if own[j][0] - own[i][0] <= 4 and rng.random() < 0.3}
        pairs += [(own[i][1], own[j][1], c) for i, j in linked]
        for i in range(200):
            bad = [j for j in range(200) if (i, j) in linked and own[j][1] not in gone]
            if own[i][1] not in gone and bad:
                gone |= {own[i][1]} if max(own[j][2] for j in bad) > own[i][2] else {own[j][1] for j in bad}
    scores = spark.createDataFrame(rows, "snp bigint, chrom bigint, ord bigint, score bigint")
    got = filters.linked_prune(scores, spark.createDataFrame(pairs, "snp1 bigint, snp2 bigint, chrom bigint"))
    assert {r.snp for r in got.collect()} == {r[0] for r in rows} - gone


def test_duplicate_probe_needs_equal_calls(spark):
    rng = np.random.default_rng(2)
    rows = [(s, n, int(g)) for n in "abcdef" for s, g in enumerate(rng.integers(0, 3, 300))]
    rows += [(s, "twin", g) for s, n, g in rows if n == "c" and s % 97]
    got = qc.duplicate_samples(calls(spark, rows)).collect()
    assert [(r.a, r.b) for r in got] == [("c", "twin")] and got[0].shared == got[0].same


def test_d_blocks_match_the_spread_of_tuples(spark):
    m = simulated(spark)
    quads = fstats.three_pairings(["O", "A", "B", "C", "X"])
    rows = fstats.spread(m, quads, 4).where("p0 + p1 + p2 + p3 is not null")
    one = lambda a, b: F.col(a) * (1 - F.col(b))
    baba = one("p0", "p1") * one("p2", "p3") + one("p1", "p0") * one("p3", "p2")
    want = {(r.qid, r.block): r.v for r in rows.groupBy("qid", "block").agg(F.sum(baba).alias("v")).collect()}
    got = {(r.qid, r.block): r.baba for r in fstats.d_blocks(m, quads, cells=500).collect()}
    assert got == pytest.approx(want)


def fourier_by_loops(full, x, w):
    g = len(x)
    c0 = x.mean()
    s = (x - c0) / np.sqrt(w)
    rho = np.corrcoef(s, np.roll(s, -1))[0, 1]
    d = (1 + 2 * rho * np.cos(2 * np.pi * np.arange(g) / g)) ** -0.5
    c = np.array([sum(d[k] * np.cos(2 * np.pi * k * i / g) for k in range(g)) for i in range(g)])
    c /= c.sum()
    white = np.array([sum(c[(i - k) % g] * (x[k] - c0) for k in range(g)) for i in range(g)]) + c0
    q = rho * np.sqrt(w * np.roll(w, -1))
    new = np.array([sum(c[k] ** 2 * w[(i + k) % g] + c[k] * c[(k + 1) % g] * q[(i + k) % g] for k in range(g)) for i in range(g)])
    mean, cov = jackknife.vector(white[:, None], np.array([full]), new / new.mean())
    return mean[0], np.sqrt(cov[0, 0]), rho


def test_fourier_jackknife():
    rng = np.random.default_rng(4)
    noise = rng.normal(size=61)
    x = 1 + 0.01 * (noise + 0.4 * np.roll(noise, 1))[:60]
    w = rng.uniform(50, 150, 60)
    got = jackknife.fourier(1.0, x, w)
    if got[2] > 0:
        assert got == pytest.approx(fourier_by_loops(1.0, x, w))
    turn = np.where(np.arange(60) % 2, 1.01, 0.99)
    plain = jackknife.vector(turn[:, None], np.array([1.0]), w)
    assert jackknife.fourier(1.0, turn, w) == pytest.approx((plain[0][0], np.sqrt(plain[1][0, 0]), 0.0))
    smooth = 1 + 0.01 * np.sin(2 * np.pi * np.arange(60) / 60)
    assert np.isnan(jackknife.fourier(1.0, smooth, np.full(60, 100.0))[1])


def test_mixture_of_an_exact_matrix(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(3, 3))
    m = a @ a.T + np.eye(3)
    share = np.linalg.solve(m, np.ones(3))
    upper = m[np.triu_indices(3)]
    rows = [(k, b, float(v) * 10, 10) for b in range(5) for k, v in enumerate(upper)]
    coefficients, errors = numeric.mixture(spark.createDataFrame(rows, "qid int, block int, top double, n bigint"), 3)
    assert coefficients == pytest.approx(share / share.sum()) and errors == pytest.approx([0, 0, 0], abs=1e-9)


def test_joint_test_counts_independent_statistics():
    f = np.array([1.0, 2.0, 3.0])
    cov = np.array([[1.0, 0, 1], [0, 4, 4], [1, 4, 5]])  # the third is the sum of the others
    assert basis.joint_test(f, cov) == (pytest.approx(1 + 1), 2)


def test_dates_of_an_exact_decay():
    import pandas as pd

    bins = np.arange(40)
    y = 0.2 + np.exp(-30 * (bins + 0.5) * 0.01)
    whole = pd.DataFrame({"bin": bins, "regression": y})
    own = pd.concat([pd.DataFrame({"chrom": c, "bin": bins, "regression": y}) for c in (1, 2, 3)])
    rows, se = numeric.dates(whole, own, {1: 10, 2: 20, 3: 30}, 0.01)
    assert [k for k, _ in rows] == [None, 1, 2, 3] and [v for _, v in rows] == pytest.approx([30] * 4, rel=1e-3) and se < 1


def test_dates_of_tables_without_a_curve():
    import pandas as pd

    table = lambda **c: pd.DataFrame(c | {"regression": np.array(c["regression"], dtype=float)})
    none = table(bin=np.zeros(0, int), regression=[])
    assert numeric.dates(none, table(chrom=np.zeros(0, int), bin=np.zeros(0, int), regression=[]), {}, 0.01, []) == ([(None, None)], None)
    # Two bins fit any rate; one chromosome alone leaves nothing.
    bins = np.arange(5)
    y = np.exp(-30 * (bins + 0.5) * 0.01)
    two = table(chrom=[1, 1], bin=[0, 3], regression=[1.0, 0.5])
    rows, se = numeric.dates(table(bin=bins, regression=y), two, {1: 10, 2: 20}, 0.01, [1, 2])
    assert rows == [(None, pytest.approx(30, rel=1e-3)), (1, None), (2, None)] and se is None
    # Steps to rates whose exponentials pass a double are not taken.
    for seed in range(60):
        y = np.random.default_rng(seed).normal(size=4)
        for d in (np.array([0.0, 1, 2, 3]), np.array([0.5, 1e3, 2e3, 1e6])):
            assert np.isfinite(numeric.exponential_fit(d, y)).all()


def test_dates_of_calls_that_share_no_samples(spark, tmp_path):
    """Tables so thin that no pair of markers has four common samples."""
    table = lambda name, rows, kinds: spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / f"{name}.parquet"))
    table("nation", [(k, k % 5) for k in range(25)], "n_nationkey int, n_regionkey int")
    table("part", [(k,) for k in range(30)], "p_partkey bigint")
    table("supplier", [(k, k % 25) for k in range(50)], "s_suppkey bigint, s_nationkey int")
    table("lineitem", [(k, (7 * k + 11 * j) % 50, float(k + j)) for k in range(30) for j in range(5)], "l_partkey bigint, l_suppkey bigint, l_quantity double")
    assert [tuple(r) for r in models.decay_dates(spark, str(tmp_path)).collect()] == [(None, None, None)]


def test_pair_classes(spark):
    df = spark.createDataFrame([(a, b) for a in "ACGTX" for b in "ACGTX"], "a string, b string")
    got = {(r.a, r.b): r.c for r in df.select("a", "b", pair_class(F.col("a"), F.col("b")).alias("c")).collect()}
    assert {k for k, v in got.items() if v == 1} == {("A", "G"), ("T", "C")} and {k for k, v in got.items() if v == 5} == {("C", "T"), ("G", "A")}
    assert got["A", "A"] == -1 and got["X", "A"] == -1 and got["C", "A"] == got["G", "T"] == 3


def test_names_must_fit(spark):
    g = calls(spark)
    names = g.select("sample").distinct().withColumn("new", F.concat(F.lit("n"), F.col("sample").cast("string")))
    assert merges.remap_samples(g, names).count() == g.count()
    with pytest.raises(ValueError):
        merges.remap_samples(g, names.limit(1))
