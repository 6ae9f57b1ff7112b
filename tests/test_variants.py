"""Flat pairs, differences of ratios, trimmed blocks, errors of heterozygosity and spectrum files against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelica.operators import fstats, jackknife
from allelica.sources import formats
from tests.test_operators import simulated


@pytest.fixture(scope="module")
def gaps(spark):
    """Markers where some populations lack data and some frequencies agree."""
    m = simulated(spark, snps=600)
    m = m.withColumn("m", F.map_filter("m", lambda p, x: F.pmod(F.xxhash64("snp", p), F.lit(6)) > 0))
    level = F.transform_values("m", lambda p, x: x.withField("p", F.round(x["p"], 1)))
    return m.withColumn("m", level).cache()


def plain_flat(m, q):
    a, b, c, d = (m.get(x) for x in q)
    shared = q[0] in q[2:] or q[1] in q[2:]
    if not shared and any(x and y and abs(x.p - y.p) < 1e-5 for x, y in ((a, b), (c, d))):
        return 0.0
    if None in (a, b, c, d):
        return None
    top = (a.p - b.p) * (c.p - d.p)
    for i, j, sign in ((0, 2, 1), (1, 3, 1), (0, 3, -1), (1, 2, -1)):
        top += sign * m[q[i]].c if q[i] == q[j] else 0
    return top


def plain_jackknife(sums, weights, of):
    """Mean and error of ``of`` the summed vectors, by blocks of those weights."""
    keys = sorted(k for k in sums if weights[k] > 0)
    x, w = np.array([sums[k] for k in keys]), np.array([weights[k] for k in keys], dtype=float)
    full, less = of(x.sum(axis=0)), np.array([of(x.sum(axis=0) - row) for row in x])
    h = w.sum() / w
    mean = (full - less).sum() + (less / h).sum()
    tau = h * full - (h - 1) * less
    return full, mean, float(np.sqrt(((tau - mean) ** 2 / (h - 1)).mean())), less


def block_sums(markers, terms):
    sums, n = {}, {}
    for r in markers.collect():
        v = terms(r.m)
        if None not in v:
            sums[r.block], n[r.block] = sums.get(r.block, 0) + np.array(v), n.get(r.block, 0) + 1
    return sums, n


@pytest.mark.parametrize("q", [("C", "O", "X", "B", "C", "O", "A", "B"), ("A", "O", "A", "B", "C", "O", "B", "C"), ("A", "B", "B", "A", "O", "X", "X", "C")])
def test_flat_ratio(gaps, q):
    sums, n = block_sums(gaps, lambda m: [plain_flat(m, q[:4]), plain_flat(m, q[4:])])
    full, _, se, _ = plain_jackknife(sums, n, lambda s: s[0] / s[1])
    r = fstats.f4_ratio(gaps, [q], flat=True).first()
    assert (r.alpha, r.se, r.nsnp, r.blocks) == (pytest.approx(full), pytest.approx(se), sum(n.values()), len(n))
    if len({*q[:4]}) == 4:
        assert r.nsnp > fstats.f4_ratio(gaps, [q]).first().nsnp


@pytest.mark.parametrize("flat", [False, True])
def test_flat_difference(gaps, flat):
    q = ("C", "O", "X", "B", "C", "A", "X", "B")
    known = lambda m, t: plain_flat(m, t) if flat else None if any(x not in m for x in t) else (m[t[0]].p - m[t[1]].p) * (m[t[2]].p - m[t[3]].p)
    pairs = [(known(r.m, q[:4]), known(r.m, q[4:])) for r in gaps.collect()]
    both = [2 * a - b for a, b in pairs if a is not None and b is not None]
    r = fstats.f4_difference(gaps, [q], factor=2.0, flat=flat).first()
    assert (r.diff, r.nsnp) == (pytest.approx(sum(both) / len(both)), len(both))
    a, b = ([x[k] for x in pairs if x[k] is not None] for k in (0, 1))
    apart = fstats.f4_difference(gaps, [q], factor=2.0, overlap=False, flat=flat).first()
    assert apart.diff == pytest.approx(2 * sum(a) / len(a) - sum(b) / len(b))


@pytest.mark.parametrize("flat", [False, True])
def test_ratio_difference(gaps, flat):
    a, b = ("C", "O", "X", "B", "C", "O", "A", "B"), ("B", "O", "X", "A", "B", "O", "C", "A")

    def terms(m):
        if not flat and any(x not in m for x in a + b):
            return [None]
        return [plain_flat(m, q[i : i + 4]) for q in (a, b) for i in (0, 4)]

    sums, n = block_sums(gaps, terms)
    full, _, se, _ = plain_jackknife(sums, n, lambda s: s[0] / s[1] + s[2] / s[3] - 1)
    r = fstats.f4_ratio_difference(gaps, [a + b], flat=flat).first()
    assert (r.excess, r.se, r.nsnp) == (pytest.approx(full), pytest.approx(se), sum(n.values()))


@pytest.mark.parametrize("share", [0.0, 0.05, 0.2])
def test_trimmed(spark, share):
    rng = np.random.default_rng(3)
    rows = [(0, k, float(t), float(b), int(w)) for k, (t, b, w) in enumerate(zip(rng.normal(1, 1, 31), rng.uniform(1, 2, 31), rng.integers(0, 9, 31), strict=True))]
    sums, weights = {r[1]: np.array(r[2:4]) for r in rows if r[4]}, {r[1]: r[4] for r in rows}
    whole = plain_jackknife(sums, weights, lambda s: s[0] / s[1])
    order = [k for _, k in sorted(zip(whole[3], sorted(sums), strict=True))]
    cut = int(share * len(order) + 0.5)
    kept = order[cut : len(order) - cut]
    middle = plain_jackknife({k: sums[k] for k in kept}, weights, lambda s: s[0] / s[1])
    r = jackknife.trimmed(spark.createDataFrame([x for x in rows if x[4]], "qid int, block int, top double, bot double, n int"), ["qid"], share).first()
    assert (r.est, r.jack, r.se, r.blocks) == (pytest.approx(middle[0]), pytest.approx(middle[1]), pytest.approx(whole[2]), len(kept))


def test_heterozygosity_errors(spark):
    m = simulated(spark, snps=400)
    m = m.withColumn("m", F.map_filter("m", lambda p, x: ~((p == "A") & (F.col("block") == 2)) & (F.pmod(F.xxhash64("snp", p), F.lit(6)) > 0)))
    got = {(r.a, r.b): r for r in fstats.heterozygosity_errors(m, ["A", "B"]).collect()}
    rows = m.collect()
    held = {r.block: sum(x.block == r.block for x in rows) for r in rows}
    for a, b in (("A", "A"), ("A", "B"), ("B", "B")):
        sums = {k: np.zeros(2) for k in held}
        for r in rows:
            if a in r.m and b in r.m:
                x, y = r.m[a], r.m[b]
                u, v = round(x.p * x.n), round(y.p * y.n)
                sums[r.block] += (2 * u * (x.n - u), x.n * (x.n - 1)) if a == b else (u * (y.n - v) + (x.n - u) * v, x.n * y.n)
        _, mean, se, _ = plain_jackknife(sums, held, lambda s: s[0] / s[1])
        assert (got[a, b].het, got[a, b].se, got[a, b].blocks) == (pytest.approx(mean), pytest.approx(se), len(held))


def test_spectrum_file(spark, tmp_path):
    rows = [(0, 0, 0.5, 0.0), (1, 2, 0.25, 0.125), (0, 1, 0.25, 0.0625)]
    lines = [r.value for r in formats.spectrum_lines(spark.createDataFrame(rows, "k0 int, k1 int, share double, se double"), {"A": 1, "B": 2}).collect()]
    assert lines[0] == "newformat:" and lines[1].split() == ["sampsizes:", "A", "::", "1", ";", "B", "::", "2"]
    assert [x.split()[1:] for x in lines[2:4]] == [["0:", "0", "0", "0.500000000", "0.062500000"], ["1:", "0", "1", "0.250000000", "0.062500000"]]
    assert len(lines) == 8
    (tmp_path / "spec").write_text("\n".join(lines + ["spec:     6:   1:1     2  0.5 0.25"]))
    got = {(r.k0, r.k1): (r.share, r.se) for r in formats.read_spectrum(spark, str(tmp_path / "spec"), 2).collect()}
    assert got == {(0, 0): (0.5, 0.0625), (0, 1): (0.25, 0.0625), (0, 2): (0.0, 0.0625), (1, 0): (0.0, 0.0625), (1, 1): (0.0, 0.0625), (1, 2): (0.25, 0.125), (2, 2): (0.5, 0.25)}
    none = formats.spectrum_lines(spark.createDataFrame([], "k0 int, share double, se double"), {"A": 1}).collect()
    assert len(none) == 4
