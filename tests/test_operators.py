"""Closed forms, invariants and hand-made cases of the genotype operators."""

import numpy as np
import pytest

from allelica.functions import tails
from allelica.functions.alleles import chromosome, id_hash, match_code, ordered_hash
from allelica.operators import blocks, counts, filters, fstats, jackknife, linkage, merges, qc, transforms
from pyspark.sql import functions as F


def test_tails_against_known_values():
    for x, dof, want in ((0.536, 2, 0.764860), (2.767, 3, 0.428944), (2.710, 3, 0.438595), (19.817, 4, 0.000542598)):
        assert tails.chi_square_tail(x, dof) == pytest.approx(want, rel=1e-3)
    assert tails.normal_tail(1.959964) == pytest.approx(0.025, rel=1e-5)
    assert tails.f_tail(4.0, 1, 10) == pytest.approx(2 * tails.student_tail(2.0, 10), rel=1e-9)


def test_greedy_blocks_are_not_fixed_bins():
    at = np.array([0, 4, 9, 10, 11, 19, 20, 30])
    assert blocks.greedy_starts(at, 10).tolist() == [0, 0, 0, 1, 1, 1, 2, 3]
    assert blocks.greedy_starts(np.array([3, 9, 13, 14, 23]), 10).tolist() == [0, 0, 1, 1, 2]


def test_blocks_number_on_over_chromosomes(spark):
    m = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 12, 1), (3, 2, 0, 0)], "snp bigint, chrom bigint, genpos bigint, physpos bigint")
    assert {r.snp: r.block for r in blocks.assign_blocks(m, 10).collect()} == {1: 1, 2: 2, 3: 3}


def test_blocks_of_joined_maps_are_those_of_the_plain_walk(spark):
    """Chromosomes of one place, with gaps, dense, and with places below zero; markers without a place go."""
    rng = np.random.default_rng(8)
    places = {1: [5], 2: rng.integers(-400, 9000, 700), 3: np.concatenate([rng.integers(0, 60, 40), rng.integers(8000, 8100, 60)]), 4: np.arange(0, 500, 10)}
    rows = [(c, int(p)) for c, ps in places.items() for p in ps]
    want, before = {}, 1
    for c, ps in places.items():
        at = np.unique(ps)
        number = blocks.greedy_starts(at, 10)
        want |= {(c, int(p)): before + int(k) for p, k in zip(at, number, strict=True)}
        before += int(number[-1]) + 1
    m = spark.createDataFrame([*rows, (2, None)], "chrom bigint, genpos bigint").coalesce(2)
    for span in (2, 16):
        got = blocks.assign_blocks(m, 10, span).collect()
        assert sorted((r.chrom, r.genpos, r.block) for r in got) == sorted((c, p, want[c, p]) for c, p in rows)
    assert blocks.assign_blocks(m.where("chrom > 9"), 10).count() == 0


def test_jackknife_with_equal_weights_is_the_textbook_one(spark):
    x = [1.0, 2.0, 4.0, 7.0]
    df = spark.createDataFrame([(0, k, v, 1.0, 1) for k, v in enumerate(x)], "qid int, block int, top double, bot double, n bigint")
    r = jackknife.ratio(df, ["qid"]).first()
    assert r.est == pytest.approx(3.5) and r.jack == pytest.approx(3.5)
    assert r.se == pytest.approx(np.std(x, ddof=1) / 2)
    without = (np.sum(x) - np.array(x)) / 3
    mean, cov = jackknife.vector(without[:, None], np.array([3.5]), np.ones(4))
    assert mean[0] == pytest.approx(3.5) and cov[0, 0] == pytest.approx(r.se**2)
    assert jackknife.effective_blocks(np.ones(4)) == pytest.approx(4)


def test_one_block_has_no_error(spark):
    df = spark.createDataFrame([(0, 1, 1.0, 2.0, 3)], "qid int, block int, top double, bot double, n bigint")
    assert jackknife.ratio(df, ["qid"]).first().se is None


def simulated(spark, share=0.3, snps=3000, seed=5):
    """Four populations with a drifted mixture: X of A and B, outgroups O and C, 40 samples each."""
    rng = np.random.default_rng(seed)
    root = rng.uniform(0.1, 0.9, snps)
    drift = lambda p, f: np.clip(p + rng.normal(0, np.sqrt(f * p * (1 - p))), 0.001, 0.999)
    ab = drift(root, 0.05)
    p = {"O": drift(root, 0.02), "A": drift(ab, 0.05), "B": drift(root, 0.08)}
    p["C"] = drift(p["A"], 0.03)
    p["X"] = drift(share * p["A"] + (1 - share) * p["B"], 0.01)
    rows = [(k, "OABCX".index(n), n, int(g0), int(80 - g0)) for n, q in p.items() for k, g0 in enumerate(rng.binomial(80, 1 - q))]
    df = spark.createDataFrame([(k, n, a, b, k // 60) for k, _, n, a, b in rows], "snp int, pop string, n0 bigint, n1 bigint, block int")
    return counts.by_marker(counts.moments(df)).cache()


def test_f4_ratio_recovers_the_mixture(spark):
    r = fstats.f4_ratio(simulated(spark), [("C", "O", "X", "B", "C", "O", "A", "B")]).first()
    assert abs(r.alpha - 0.3) < 3 * r.se and r.se < 0.1


def test_f_statistic_identities(spark):
    m = simulated(spark)
    a, b = (x.f4 for x in fstats.f4_statistic(m, [("A", "B", "C", "O"), ("B", "A", "C", "O")]).orderBy("qid").collect())
    assert a == pytest.approx(-b)
    basis = {x.qid: x for x in fstats.basis_blocks(m, ["O", "A", "B", "C"]).groupBy("qid").agg((F.sum("top") / F.sum("bot")).alias("v")).collect()}
    # Pairs in order: AA AB AC BB BC CC. f(A, B; C, O) = B(A, C) - B(B, C).
    assert basis[2].v - basis[4].v == pytest.approx(a)
    with pytest.raises(ValueError):
        fstats.dstat(m, [("A", "A", "B", "C")])


def test_admixed_population_has_negative_f3(spark):
    r = fstats.f3(simulated(spark), [("A", "B", "X")]).first()
    assert r.f3 < 0 and r.z < -3


def test_match_codes(spark):
    rows = [("A", "C", "A", "C", 1), ("A", "C", "C", "A", 2), ("A", "C", "T", "G", 1), ("A", "C", "G", "T", 2), ("A", "T", "A", "T", -2), ("A", "C", "A", "G", 0), ("A", "C", "N", "C", -1), ("A", "X", "A", "G", 1)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, want int")
    got = df.select("want", match_code(*[F.col(c) for c in "abcd"]).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_chromosome_names(spark):
    df = spark.createDataFrame([("chr1", 1), ("X", 23), ("Y", 24), ("MT", 90), ("2B", 2), ("?", 99)], "n string, want int")
    assert all(r.want == r.got for r in df.select("want", chromosome(F.col("n")).alias("got")).collect())


def test_id_hash_depends_on_order(spark):
    ids = ["S1", "S2", "Sample10"]
    df = spark.createDataFrame(list(enumerate(ids)), "ord int, id string")
    assert ordered_hash(df, "id", "ord").first().hash.lstrip("0") == id_hash(ids) != id_hash(ids[::-1])


G = [(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "a", 2), (2, "b", 1)]


def calls(spark, rows=None):
    return spark.createDataFrame(rows or G, "snp bigint, sample string, g bigint")


def test_merges(spark):
    m = spark.createDataFrame([(1, "A", "C", 1, 5), (2, "A", "C", 1, 9)], "snp bigint, ref string, alt string, chrom int, physpos bigint")
    m2 = spark.createDataFrame([(1, "C", "A", 1, 5), (2, "A", "G", 1, 9)], "snp bigint, ref string, alt string, chrom int, physpos bigint")
    other = calls(spark, [(1, "d", 0), (2, "d", 1)])
    got = {(r.snp, r.sample): r.g for r in merges.merge(calls(spark), m, other, m2).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 2}
    with pytest.raises(ValueError):
        merges.merge(calls(spark), m, calls(spark), m2)
    first = merges.multi_merge([calls(spark, [(1, "a", 1)]), calls(spark)])
    assert {(r.snp, r.sample): r.g for r in first.collect()}[(1, "a")] == 1
    union = merges.marker_union(calls(spark, [(1, "a", 1)]), calls(spark))
    assert sorted((r.snp, r.sample, r.g) for r in union.collect()) == [(1, "a", 1), (2, "a", 2)]


def test_transforms(spark):
    g = calls(spark)
    assert transforms.hets_to(g).count() == 3
    assert sorted(r.g for r in transforms.hets_to(g, "reference").collect()) == [0, 2, 2, 2, 2]
    pol = {(r.snp, r.sample): r.g for r in transforms.polarize(g, "a").collect()}
    assert pol[(1, "a")] == 2 and pol[(1, "c")] == 0 and pol[(2, "a")] == 2
    back = transforms.to_diploid(transforms.to_haploid(g))
    assert sorted(map(tuple, back.select("snp", "sample", "g").collect())) == sorted(G)
    sample = spark.createDataFrame([(s, 0) for s in "abcd"], "sample string, pop int")
    marker = spark.createDataFrame([(1,), (2,)], "snp bigint")
    full = transforms.fill_missing(g, sample, marker)
    assert full.count() == 8 and full.join(g, ["snp", "sample", "g"]).count() == 5
    assert transforms.shuffle_samples(g, sample, 3).count() == 5


def test_filters(spark):
    m = spark.createDataFrame([(1, 1, 100), (2, 1, 200), (3, 2, 150)], "snp bigint, chrom bigint, physpos bigint")
    regions = spark.createDataFrame([(1, 150, 200)], "chrom bigint, low bigint, high bigint")
    assert sorted(r.snp for r in filters.outside_regions(m, regions, 60).collect()) == [1, 3]
    sample = spark.createDataFrame([(s, "p" if s < "c" else "q") for s in "abc"], "sample string, pop string")
    assert [r.snp for r in filters.min_valid(calls(spark), sample, 1).collect()] == [1]
    assert filters.capped_samples(sample, 1).count() == 2


def test_pair_band_meets_every_pair_once(spark):
    rng = np.random.default_rng(1)
    at = np.unique(rng.integers(0, 500, 120))
    m = spark.createDataFrame([(k, 1, int(g)) for k, g in enumerate(at)], "snp bigint, chrom bigint, genpos bigint")
    got = sorted((r.snp1, r.snp2) for r in linkage.marker_pairs(m, 40).collect())
    assert got == [(i, j) for i in range(len(at)) for j in range(i + 1, len(at)) if at[j] - at[i] < 40]


def test_duplicate_samples(spark):
    rng = np.random.default_rng(2)
    rows = [(s, n, int(g)) for n in "abcdef" for s, g in enumerate(rng.integers(0, 3, 300))]
    rows += [(s, "twin", g) for s, n, g in rows if n == "c"]
    got = qc.duplicate_samples(calls(spark, rows)).collect()
    assert [(r.a, r.b, r.shared, r.same) for r in got] == [("c", "twin", 300, 300)]


def test_spectrum_sums_to_the_markers(spark):
    c = spark.createDataFrame([(1, 1, 3, 2), (1, 2, 4, 0), (2, 1, 1, 0), (2, 2, 3, 3)], "snp bigint, pop bigint, n0 bigint, n1 bigint")
    rows = qc.joint_spectrum(c, {1: 2, 2: 2}).collect()
    assert sum(r.expected for r in rows) == pytest.approx(1)
    assert {(r.k0, r.k1): r.expected for r in rows if r.expected}[(1, 0)] == pytest.approx(2 * 3 / 10)
