"""Packed tiles, haplotype EM, score decay and interaction against plain loops."""

import itertools
import math

import numpy as np
import pytest

from allelica.functions import two_locus
from allelica.operators import linkage, tiles
from tests.test_reports import sparse


def plain_cells(g, groups, k, i, j):
    out = [0] * 9
    for s, grp in enumerate(groups):
        if grp == k and g[i][s] >= 0 and g[j][s] >= 0:
            out[3 * g[i][s] + g[j][s]] += 1
    return out


@pytest.mark.parametrize("tile", [1, 4, 100])
def test_cells_of_groups(spark, tile):
    g, df = sparse(spark, samples=30, snps=25)
    place = [int(x) for x in np.random.default_rng(tile).integers(0, 120, len(g))]
    place[5] = place[4]  # two markers at one place are no pair
    marker = spark.createDataFrame([(k, 1 + k % 2, place[k]) for k in range(len(g))], "snp bigint, chrom bigint, genpos bigint")
    groups = [s % 3 if s % 7 else None for s in range(30)]
    sample = spark.createDataFrame([(s, x) for s, x in enumerate(groups) if x is not None], "sample bigint, grp int")
    got = {(r.snp1, r.snp2): r for r in tiles.pair_cells(df, marker, 50, sample, tile).collect()}
    near = [(i, j) for i in range(25) for j in range(25) if i % 2 == j % 2 and 0 < place[j] - place[i] < 50]
    assert len(near) > 60 and set(got) == {p for p in near if any(sum(plain_cells(g, groups, k, *p)) for k in range(3))}
    for (i, j), r in got.items():
        assert r.distance == place[j] - place[i] and r.chrom == 1 + i % 2
        assert [r.cells0, r.cells1, r.cells2] == [plain_cells(g, groups, k, i, j) for k in range(3)]


def test_no_cells(spark):
    g, df = sparse(spark, samples=5, snps=4)
    marker = spark.createDataFrame([(k, 1, 100 * k) for k in range(4)], "snp bigint, chrom bigint, genpos bigint")
    assert tiles.pair_cells(df, marker, 50).count() == 0 and tiles.pair_cells(df.limit(0), marker, 500).count() == 0


def test_large_counts_stay_exact_enough(spark):
    """Sums whose products pass 64 bits."""
    n = 10**9
    df = spark.createDataFrame([(1, 2, 1, 5, n, n, n, 3 * n // 2, 3 * n // 2, 5 * n // 4)], "snp1 long, snp2 long, chrom long, distance long, n long, x long, y long, xx long, yy long, xy long")
    r2 = (0.25 / 0.5) ** 2
    assert linkage.r_squared(df).first().r2 == pytest.approx(r2) and linkage.chi_square(df).first().chi2 == pytest.approx(n * r2)


def plain_em(t):
    """(ratio, z, haplotypes) over all ordered pairs of haplotypes."""
    n = sum(t)
    a = sum(t[3 * g + h] * g for g in range(3) for h in range(3)) / (2 * n)
    b = sum(t[3 * g + h] * h for g in range(3) for h in range(3)) / (2 * n)
    p = apart = [(1 - a) * (1 - b), (1 - a) * b, a * (1 - b), a * b]

    def like(p):
        cell = [1e-20] * 9
        for x, y in itertools.product(range(4), repeat=2):
            cell[3 * (x // 2 + y // 2) + x % 2 + y % 2] += p[x] * p[y]
        return sum(k * math.log(c) for k, c in zip(t, cell, strict=True)), cell

    base, last = like(p)[0], -math.inf
    for _ in range(10):
        value, cell = like(p)
        new = [0.0] * 4
        for x, y in itertools.product(range(4), repeat=2):
            k = 3 * (x // 2 + y // 2) + x % 2 + y % 2
            for h in (x, y):
                new[h] += t[k] * p[x] * p[y] / cell[k]
        p = [v / sum(new) for v in new]
        if value - base < last + 1e-3:
            last = value - base
            break
        last = value - base
    return 2 * last, math.sqrt(max(0, 2 * last)) * (-1 if p[0] < apart[0] else 1), p


def test_em_of_many_tables():
    rng = np.random.default_rng(5)
    tables = rng.integers(0, 12, (300, 9)) * (rng.random((300, 9)) < 0.7)
    tables = np.vstack([tables[tables.sum(axis=1) > 2], [[0, 0, 0, 0, 9, 0, 0, 0, 0], [5, 0, 0, 0, 0, 0, 0, 0, 5], [0, 0, 5, 0, 0, 0, 5, 0, 0], [7, 0, 0, 0, 0, 0, 0, 0, 0]]])
    got = two_locus.linkage(tables)
    for k, t in enumerate(tables.tolist()):
        ratio, z, p = plain_em(t)
        assert got.ratio[k] == pytest.approx(ratio, abs=1e-6) and got.haplotypes[k] == pytest.approx(p, abs=1e-8)
        assert abs(got.z[k]) == pytest.approx(abs(z), abs=1e-4) and (abs(z) < 1e-3 or got.z[k] * z > 0)
    assert got.dprime[-3:].tolist() == pytest.approx([1, 1, 0], abs=1e-3) and got.z[-3] > 0 > got.z[-2]
    none = two_locus.linkage([[1, 0, 0, 0, 1, 0, 0, 0, 0]])
    assert np.isnan(none.ratio).all() and len(two_locus.linkage(np.zeros((0, 9))).z) == 0


def test_score_decay_finds_the_linked_bins(spark):
    """Markers that copy their neighbour have large scores at that distance, unless a parent is linked as well."""
    rng = np.random.default_rng(6)
    g = rng.integers(0, 3, (40, 120))
    g[1::2] = np.where(rng.random((20, 120)) < 0.9, g[::2], g[1::2])
    df = spark.createDataFrame([(i, s, int(g[i, s])) for i in range(40) for s in range(120)], "snp bigint, sample bigint, g bigint")
    marker = spark.createDataFrame([(k, 1, 100 * (k // 2) + 10 * (k % 2)) for k in range(40)], "snp bigint, chrom bigint, genpos bigint")
    weights = spark.createDataFrame([(k, 1.0) for k in range(40)], "snp bigint, weight double")
    out = {r.bin: r for r in linkage.score_decay(tiles.pair_cells(df, marker, 150), weights, 50).collect()}
    assert out[0].pairs == 20 and out[0].regression > 5 > abs(out[2].regression) and out[0].correlation > 0.9
    assert out[0].z == pytest.approx(out[0].regression * math.sqrt(20))
    sample = spark.createDataFrame([(s, s % 2) for s in range(120)], "sample bigint, grp int")
    kept = {r.bin: r.pairs for r in linkage.score_decay(tiles.pair_cells(df, marker, 150, sample), weights, 50, parents=(1,)).collect()}
    assert 0 not in kept and kept[2] > 0
    few = linkage.score_decay(tiles.pair_cells(df, marker, 150, sample), weights, 50, parents=(1,), parent_calls=61)
    assert few.count() == 0


def plain_logistic(case, control, rows):
    """Newton steps of one table; a step that loses is halved."""
    beta = np.zeros(len(rows[0]))
    like = lambda b: sum(c * (e := float(np.dot(r, b))) - (c + d) * math.log1p(math.exp(e)) for c, d, r in zip(case, control, rows, strict=True))
    for _ in range(60):
        grad, hess = np.zeros(len(beta)), np.zeros((len(beta),) * 2)
        for c, d, r in zip(case, control, rows, strict=True):
            p = 1 / (1 + math.exp(-float(np.dot(r, beta))))
            grad += (c - (c + d) * p) * np.array(r)
            hess += (c + d) * p * (1 - p) * np.outer(r, r)
        step = np.linalg.solve(hess, grad)
        while like(beta + step) < like(beta) - 1e-12:
            step = step / 2
        beta = beta + step
    return like(beta)


def test_interaction_of_many_tables():
    rng = np.random.default_rng(7)
    case, control = rng.integers(0, 15, (40, 9)), rng.integers(0, 15, (40, 9))
    case[0], control[1] = 0, 0
    got = two_locus.interaction(case, control)
    dummies = [[1.0, e == 1, e == 2, f == 1, f == 2] for e in range(3) for f in range(3)]
    for k in range(40):
        a, b = case[k] + 0.1, control[k] + 0.1
        full = plain_logistic(a, b, np.eye(9).tolist())
        assert got[k] == pytest.approx(2 * (full - plain_logistic(a, b, dummies)), abs=1e-5)
    # Shares of cases that add up on the logistic scale show no interaction.
    odds = np.exp(two_locus.additive_design() @ np.array([0.3, -0.2, 0.5, 0.1, -0.4]))
    assert abs(two_locus.interaction([1000 * odds / (1 + odds)], [1000 / (1 + odds)], 0.0)[0]) < 1e-8


def test_epistasis_of_pairs(spark):
    g, df = sparse(spark, samples=60, snps=10)
    marker = spark.createDataFrame([(k, 1, k) for k in range(10)], "snp bigint, chrom bigint, genpos bigint")
    groups = [s % 2 for s in range(60)]
    sample = spark.createDataFrame(list(enumerate(groups)), "sample bigint, grp int")
    rows = linkage.epistasis(tiles.pair_cells(df, marker, 20, sample)).collect()
    assert len(rows) == 45
    for r in rows:
        case, control = (plain_cells(g, groups, k, r.snp1, r.snp2) for k in (1, 0))
        assert r.interaction == pytest.approx(two_locus.interaction([case], [control])[0])


def test_words_follow_the_calls(spark):
    """A few calls among many samples take a few words; products count samples that both markers have only."""
    far = 1_000_000
    rows = [(1, 5, 2), (1, far, 1), (2, far, 2), (2, 7, 0), (3, 6, 1), (3, 77, 1)]
    df = spark.createDataFrame(rows, "snp bigint, sample bigint, g bigint")
    sample = spark.range(far + 1).selectExpr("id as sample", "0 as grp")
    packed, ranges = tiles.planes(df, sample)
    assert ranges == [(0, far // 16 + 1)]
    assert {r.snp: len(r.w) // tiles.RECORD.itemsize for r in packed.collect()} == {1: 2, 2: 2, 3: 2}
    marker = spark.createDataFrame([(k, 1, k) for k in (1, 2, 3)], "snp bigint, chrom bigint, genpos bigint")
    got = {(r.snp1, r.snp2): r.cells0 for r in tiles.pair_cells(df, marker, 10, sample, 1).collect()}
    assert got == {(1, 2): [0, 0, 0, 0, 0, 1, 0, 0, 0]}


def test_batches_of_full_markers_are_packed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(tiles, "CALLS", 50)
    g, df = sparse(spark, samples=60, snps=20)
    got = {r.snp: r.w for r in tiles.planes(df)[0].collect()}
    names = {s: k for k, s in enumerate(sorted({r.sample for r in df.select("sample").distinct().collect()}))}
    for m, raw in got.items():
        x = {int(r["w"]): r for r in np.frombuffer(raw, tiles.RECORD)}
        for s, k in names.items():
            r, bit = x.get(k // 16), k % 16
            have = [bool(r is not None and r[c] >> bit & 1) for c in tiles.PLANES]
            assert have == [g[m][s] >= 0, g[m][s] == 1, g[m][s] == 2]


def test_columns_of_markers_come_with_their_pairs(spark):
    """Also where the second tile's marker stands first, and null columns stay null."""
    g, df = sparse(spark, samples=20, snps=12)
    marker = spark.createDataFrame([(k, 1, 7 * k % 40, None if k == 3 else k / 2) for k in range(len(g))], "snp bigint, chrom bigint, genpos bigint, weight double")
    rows = tiles.pair_cells(df, marker, 25, tile=2, carry=("weight",)).collect()
    assert len(rows) > 30 and any(r.snp1 > r.snp2 for r in rows)
    for r in rows:
        assert [r.weight1, r.weight2] == [None if s == 3 else s / 2 for s in (r.snp1, r.snp2)]


def test_decay_counts_its_pairs_once(spark):
    """A chromosome that lacks a bin, a plain jackknife table, and one count of the tiles in the plan."""
    g, df = sparse(spark, samples=40, snps=24)
    place = [10 * (k // 2) if k % 2 else 12 * (k // 2) for k in range(len(g))]
    last = max(p for k, p in enumerate(place) if k % 2 == 0)
    w = [None if k == 4 else (k % 5 - 2.5) / 3 for k in range(len(g))]
    marker = spark.createDataFrame([(k, 1 + k % 2, place[k], w[k]) for k in range(len(g))], "snp bigint, chrom bigint, genpos bigint, weight double")
    sums = linkage.decay_sums(linkage.pair_tables(df, marker, 12 * 12, ("weight",)), 10)
    rows = {}
    for i, j in itertools.product(range(len(g)), repeat=2):
        both = (g[i] >= 0) & (g[j] >= 0)
        if i % 2 == j % 2 and place[j] > place[i] and both.sum() >= 4 and w[i] is not None and w[j] is not None:
            rows.setdefault((place[j] - place[i]) // 10, []).append((1 + i % 2, np.cov(g[i][both], g[j][both])[0, 1], w[i] * w[j]))
    want = {}
    for b, found in rows.items():
        for c in (1, 2):
            kept = [(x, y) for chrom, x, y in found if chrom != c]
            if kept:
                want[c, b] = (len(kept), sum(x * y for x, y in kept), sum(y * y for _, y in kept))
    out = linkage.decay_without_each(sums)
    got = {(r.chrom, r.bin): r for r in out.collect()}
    assert set(got) == set(want) and any(len({c for c, *_ in f}) == 1 for f in rows.values()) and last > 110
    for k, (pairs, lw, ww) in want.items():
        assert got[k].pairs == pairs and got[k].regression == (None if ww == 0 else pytest.approx(lw / ww))
    whole = {r.bin: r for r in linkage.decay(sums).collect()}
    for b, found in rows.items():
        x, y = np.array([f[1] for f in found]), np.array([f[2] for f in found])
        assert whole[b].pairs == len(found) and whole[b].regression == pytest.approx((x * y).sum() / (y * y).sum())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1


@pytest.mark.parametrize("meets, dense", [(1, 0), (7, 0), (0, 10**9)])
def test_calls_that_meet_and_products_count_alike(spark, monkeypatch, meets, dense):
    """Pieces of a few meetings, and products alone, also of several pieces of rows."""
    g, df = sparse(spark, samples=40, snps=30)
    at = [int(v) for v in np.random.default_rng(3).integers(0, 200, len(g))]
    marker = spark.createDataFrame([(k, 1, at[k] / 8) for k in range(len(g))], "snp bigint, chrom bigint, genpos double")
    sample = spark.createDataFrame([(s, s % 2) for s in range(40)], "sample bigint, grp int")
    for name, v in (("MEETS", meets), ("DENSE", dense), ("ROWS", 8)):
        monkeypatch.setattr(tiles, name, v)
    held, ranges = tiles.planes(df, sample)
    rows = held.orderBy("snp").toArrow()
    w, pos = rows["w"].combine_chunks(), np.array([at[k] / 8 for k in rows["snp"].to_pylist()])
    for same, few in ((True, slice(0, 30)), (False, slice(0, 11))):
        x, gx = w.take(list(range(30))[few]), pos[few]
        y, gy = (x, gx) if same else (w.take(list(range(11, 30))), pos[11:])
        by_calls = tiles.cells_by_calls(x, y, gx, gy, 4, same, ranges)
        if dense:
            assert by_calls is None
            by_calls = tiles.cells_by_products(x, y, gx, gy, 4, same, ranges)
        names = rows["snp"].to_pylist()
        other = names if same else names[11:]
        got = {(names[few][i], other[j]): c.tolist() for i, j, c in zip(*by_calls, strict=True)}
        near = [(a, b) for a in names[few] for b in other if abs(at[a] - at[b]) < 32 and (at[b] > at[a] if same else at[a] != at[b])]
        want = {p: [plain_cells(g, [s % 2 for s in range(40)], k, *p) for k in (0, 1)] for p in near}
        assert got == {p: c for p, c in want.items() if any(map(sum, c))} and len(got) > 20


def test_pairs_over_the_edges_of_wide_buckets(spark):
    """Buckets of many bands: only markers within the band of a neighbour are sent there."""
    rows = [(k, 3 * k % 17, 1) for k in range(400)] + [(k, 40 + k % 5, 2) for k in range(400)]
    df = spark.createDataFrame(rows, "snp bigint, sample bigint, g bigint")
    marker = spark.createDataFrame([(k, 1, 10 * k) for k in range(400)], "snp bigint, chrom bigint, genpos bigint")
    out = tiles.pair_cells(df, marker, 25, tile=100)
    assert out.where("distance <= 20").count() == out.count()
    plain = {(a, b) for a in range(400) for b in range(a + 1, min(a + 3, 400)) if {3 * a % 17, 40 + a % 5} & {3 * b % 17, 40 + b % 5}}
    assert {(r.snp1, r.snp2) for r in out.select("snp1", "snp2").collect()} == plain
