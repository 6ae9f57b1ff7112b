"""Programs from parameter files: the same results as from the relations, and converter chains."""

import numpy as np
import pytest

from allelica.operators import blocks, counts, fstats
from allelica.plans import front
from allelica.sources import formats, parameters

POPS = "OABCX"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(7)
    at = tmp_path_factory.mktemp("data")
    n = 400
    root = rng.uniform(0.1, 0.9, n)
    drift = lambda p, f: np.clip(p + rng.normal(0, np.sqrt(f * p * (1 - p))), 0.01, 0.99)
    freq = {"O": drift(root, 0.02), "A": drift(root, 0.05), "B": drift(root, 0.08)}
    freq["C"] = drift(freq["A"], 0.03)
    freq["X"] = drift(0.4 * freq["A"] + 0.6 * freq["B"], 0.01)
    calls = np.concatenate([rng.binomial(2, freq[p][:, None], (n, 6)) for p in POPS], axis=1)
    text = calls.astype(str)
    text[rng.random(text.shape) < 0.05] = "9"
    (at / "x.geno").write_text("".join("".join(r) + "\n" for r in text))
    (at / "x.snp").write_text("".join(f"rs{k} {1 + k // 40} {0.01 * (k % 40):.4f} {1000 * (k % 40) + 1} A C\n" for k in range(n)))
    (at / "x.ind").write_text("".join(f"{p}{i} {'MF'[i % 2]} {p}\n" for p in POPS for i in range(6)))
    (at / "quads").write_text("A B : C O\nX A :: B O\n")
    (at / "triples").write_text("A B X\n")
    (at / "left").write_text("X\nA\nB\n")
    (at / "right").write_text("O\nC\n")
    (at / "eight").write_text("C O X B C O A B\n")
    (at / "pops").write_text("O\nA\nB\nC\nX\n")
    (at / "graph").write_text("root R\nlabel O O\nlabel A A\nlabel B B\nlabel C C\nlabel X X\nedge o R O\nedge q R Q\nedge a0 Q A0\nedge a A0 A\nedge c A0 C\nedge b0 Q B0\nedge b B0 B\nadmix M A0 B0 50 50\nedge x M X\n")
    (at / "par").write_text(f"DIR: {at}\ninstem: DIR/x\npopfilename: DIR/quads\npopleft: DIR/left\npopright: DIR/right\npoplistname: DIR/pops\ngraphname: DIR/graph\n")
    return at


def param(spark, folder, **more):
    return parameters.read(spark, str(folder / "par")) | more


def test_d_statistics_match_the_relations(spark, folder):
    got = front.run(spark, "dstat", str(folder / "par")).collect()
    m, s = formats.read_snp(spark, str(folder / "x.snp")), formats.read_ind(spark, str(folder / "x.ind"))
    g = formats.read_eigenstrat(spark, str(folder / "x.geno"), m, s)
    own = blocks.assign_blocks(m.selectExpr("snp", "cast(chrom as bigint) chrom", "cast(round(genpos * 1e7) as bigint) genpos", "physpos"), 500_000)
    markers = counts.by_marker(counts.moments(counts.allele_counts(g, s)).join(own.select("snp", "block"), "snp"))
    want = fstats.dstat(markers, [("A", "B", "C", "O"), ("X", "A", "B", "O")]).orderBy("qid").collect()
    assert [(r.pop1, r.pop4) for r in got] == [("A", "O"), ("X", "O")]
    assert [(r.d, r.se, r.nsnp) for r in got] == [pytest.approx((r.d, r.se, r.nsnp)) for r in want]
    text = [r.value for r in front.lines(front.d_statistic(spark, param(spark, folder, locount="2", hicount="2"))).collect()]
    assert len(text) == 1 and text[0].startswith("result: X A B O ")


def test_other_programs(spark, folder):
    assert front.f3(spark, param(spark, folder, popfilename=f"{folder}/triples")).count() == 1
    assert front.f4_ratio(spark, param(spark, folder, popfilename=f"{folder}/eight")).first().pop8 == "B"
    assert front.f4_difference(spark, param(spark, folder, popfilename=f"{folder}/eight")).count() == 1
    assert [r.f4rank for r in front.rank_test(spark, param(spark, folder)).collect()] == [0, 1]
    full = front.admixture(spark, param(spark, folder)).where("pattern = '00'").collect()
    assert sum(r.weight for r in full) == pytest.approx(1) and all(r.se > 0 for r in full)
    (folder / "basis").write_text("".join(f"{r.value}\n" for r in front.fstats_file(spark, param(spark, folder)).collect()))
    got = {(r.kind, r.name): r.value for r in front.graph_fit(spark, param(spark, folder, fstatsname=f"{folder}/basis")).collect()}
    assert 0 <= got["share", "M"] <= 1 and got["score", ""] >= 0 and got["dof", ""] >= 1
    with pytest.raises(ValueError):
        front.f4_ratio(spark, param(spark, folder))


def test_programs_of_variants(spark, folder):
    (folder / "halves").write_text("C O X B C O A B\nC O X A C O B A\n")
    both = param(spark, folder, popfilename=f"{folder}/halves")
    plain = front.f4_ratio(spark, both | {"fancyf4": "NO"})
    whole = front.f4_ratio(spark, both | {"diffmode": "YES"}).collect()
    assert plain.count() == 2 and len(whole) == 1 and whole[0].pop16 == "A" and whole[0].se > 0
    (folder / "sources").write_text("A B X\n")
    got = front.PROGRAMS["bounds"](spark, param(spark, folder, popfilename=f"{folder}/sources", outpop="O"))
    assert [(r.pop3, r.pop4) for r in got.collect()] == [("X", "O")]
    assert front.PROGRAMS["pairs"](spark, param(spark, folder)).count() == 10
    het = front.PROGRAMS["heterozygosity"](spark, param(spark, folder)).collect()
    assert len(het) == 15 and all(0 < r.het < 1 and r.se > 0 for r in het)


def test_converter_chain(spark, folder, tmp_path):
    p = param(spark, folder, nochrom="3", malexhet="NO", maxmissfrac="0.2", hwfilter="3", wipechrom="2", outputformat="PED",
              genotypeoutname=str(tmp_path / "o.ped"), snpoutname=str(tmp_path / "o.snp"), indivoutname=str(tmp_path / "o.ind"))
    (tmp_path / "keep").write_text("A0\nA1\nB0\n")
    d = front.convert(spark, p | {"samplename": str(tmp_path / "keep")})
    front.write(d, p)
    m = formats.read_snp(spark, str(tmp_path / "o.snp"))
    back = formats.read_ped(spark, str(tmp_path / "o.ped"), m, family_names=False)
    kept = lambda df: sorted((r.snp, r["sample"], r.g) for r in df.collect())
    assert kept(back) == kept(d.genotype) and {r["sample"] for r in back.collect()} <= {"A0", "A1", "B0"}
    chroms = {r.chrom for r in d.marker.select("chrom").distinct().collect()}
    assert 3 not in chroms and 2 not in {r.chrom for r in d.genotype.join(d.marker, "snp").select("chrom").distinct().collect()}
    pruned = front.convert(spark, param(spark, folder, killr2="1", r2thresh="0.3", r2genlim="0.05"))
    assert 0 < pruned.marker.count() < 400
    assert front.convert(spark, param(spark, folder, decimate="0.1")).marker.count() < 100
