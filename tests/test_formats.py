"""File round trips and the streaming block sums."""

import pytest

from allelica.functions.alleles import id_hash
from allelica.sources import formats, parameters
from allelica.streaming import blocks

SNP = "rs1 1 0.01 1000 A C\nrs2 1 0.02 2000 G T\n# note\nrs3 X 0.5 3000 C A\n"
IND = "a M P1\nb F P1\nc U P2\nd M P2\ne F Ignore\n"
GENO = "01290\n22199\n00000\n"
WANT = {("rs1", "a"): 0, ("rs1", "b"): 1, ("rs1", "c"): 2, ("rs2", "a"): 2, ("rs2", "b"): 2, ("rs2", "c"): 1, ("rs3", "a"): 0, ("rs3", "b"): 0, ("rs3", "c"): 0, ("rs3", "d"): 0}


@pytest.fixture
def files(spark, tmp_path):
    for name, text in (("x.snp", SNP), ("x.ind", IND), ("x.geno", GENO)):
        (tmp_path / name).write_text(text)
    return tmp_path, formats.read_snp(spark, str(tmp_path / "x.snp")), formats.read_ind(spark, str(tmp_path / "x.ind"))


def rows(df):
    return {(r.snp, r.sample): r.g for r in df.collect()}


def test_eigenstrat(spark, files):
    path, m, s = files
    g = formats.read_eigenstrat(spark, str(path / "x.geno"), m, s)
    assert rows(g) == WANT
    lines = [r.value for r in formats.eigenstrat_lines(g, m, s).collect()]
    assert lines == ["01299", "22199", "00009"]
    formats.write_ancestrymap(g, str(path / "out"))
    assert rows(formats.read_ancestrymap(spark, str(path / "out"))) == WANT


def test_packed_and_bed(spark, files):
    path, m, s = files
    g = formats.read_eigenstrat(spark, str(path / "x.geno"), m, s)
    raw = [bytes(r.raw) for r in formats.packed_rows(g, m, s).collect()]
    (path / "p.geno").write_bytes(formats.packed_header("GENO", m, s) + b"".join(raw))
    assert rows(formats.read_packed(spark, str(path / "p.geno"), m, s)) == WANT
    with pytest.raises(ValueError):
        formats.read_packed(spark, str(path / "p.geno"), m.where("snp <> 'rs1'"), s)
    bed = [bytes(r.raw) for r in formats.packed_rows(g, m, s, "bed").collect()]
    (path / "p.bed").write_bytes(formats.BED_MAGIC + b"".join(bed))
    assert rows(formats.read_bed(spark, str(path / "p.bed"), m, s)) == WANT


def test_lines_are_numbered_over_parts_and_splits(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.geno").write_text("".join(f"{(k * 400 + i) % 3}2\n" + ("# note\n" if i % 50 == 0 else "") for i in range(400)))
    m = spark.createDataFrame([(f"rs{k}", k) for k in range(1200)], "snp string, ord bigint")
    s = spark.createDataFrame([("a", 0), ("b", 1)], "sample string, ord bigint")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = rows(formats.read_eigenstrat(spark, str(tmp_path), m, s))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(f"rs{k}", n): g for k in range(1200) for n, g in (("a", k % 3), ("b", 2))}


def test_transposed_round_trip(spark, files):
    path, m, s = files
    g = formats.read_eigenstrat(spark, str(path / "x.geno"), m, s)
    raw = [bytes(r.raw) for r in formats.transposed_rows(g, m, s).collect()]
    head = formats.packed_header("TGENO", m, s)
    assert len(head) == 48 and [len(r) for r in raw] == [48] * 5
    (path / "t.geno").write_bytes(head + b"".join(raw))
    assert rows(formats.read_packed(spark, str(path / "t.geno"), m, s)) == WANT


def test_ped_round_trip(spark, files):
    path, m, s = files
    g = formats.read_eigenstrat(spark, str(path / "x.geno"), m, s)
    lines = [r.value for r in formats.ped_lines(g, m, s).collect()]
    assert lines[0] == "a a 0 0 1 P1 C C G G A A" and lines[4] == "e e 0 0 2 Ignore 0 0 0 0 0 0"
    formats.write_ped(g, m, s, str(path / "out.ped"))
    assert rows(formats.read_ped(spark, str(path / "out.ped"), m, family_names=False)) == WANT
    assert [r.value.split("\t")[0] for r in formats.snp_lines(m).collect()] == ["rs1", "rs2", "rs3"]
    assert [r.value for r in formats.ind_lines(s).collect()][0] == "a\tM\tP1"


def test_probabilities(spark, files):
    path, m, s = files
    p = spark.createDataFrame([("rs1", "a", [0.25, 0.5, 0.25]), ("rs2", "d", [0.0, 0.0, 1.0])], "snp string, sample string, p array<double>")
    raw = [bytes(r.raw) for r in formats.probability_rows(p, m, s).collect()]
    assert [len(r) for r in raw] == [20, 20, 20]
    (path / "x.prob").write_bytes(b"".join(raw))
    got = {(r.snp, r.sample): r.p for r in formats.read_probabilities(spark, str(path / "x.prob"), m, s).collect()}
    assert got.keys() == {("rs1", "a"), ("rs2", "d")} and got["rs1", "a"] == pytest.approx([0.25, 0.5, 0.25], abs=1e-4)


def test_small_files(spark, tmp_path):
    (tmp_path / "w").write_text("rs1 0.5\nrs2 2\n")
    values = formats.read_values(spark, str(tmp_path / "w"))
    assert [r.value for r in formats.value_lines(values).collect()] == ["rs1 0.500000", "rs2 2.000000"]
    (tmp_path / "pops").write_text("B 2 x\nA 1\n# C\n")
    assert formats.read_list(spark, str(tmp_path / "pops")) == ["B", "A"] and formats.read_list(spark, str(tmp_path / "pops"), typed=True) == [("B", 2), ("A", 1)]
    (tmp_path / "twice").write_text("A\nA\n")
    with pytest.raises(ValueError):
        formats.read_list(spark, str(tmp_path / "twice"))
    matrix = spark.createDataFrame([("A", "B", 0.5)], "a string, b string, fst double")
    assert [r.value.split() for r in formats.phylip_lines(matrix, ["A", "B"]).collect()] == [["2"], ["A", "0.000000", "0.500000"], ["B", "0.500000", "0.000000"]]
    assert formats.result_lines(matrix, ["a", "b", "fst"], 3).first().value == "result: A B 0.500"


def test_parameters():
    files = {"more": "snpname: DIR/x.snp\n"}
    got = parameters.parse("DIR: /data # where\n# note\ngenotypename:\tDIR/x.geno\n+++ more\ninbreed: YES\nblgsize: 0.05\n", files.get)
    assert got["genotypename"] == "/data/x.geno" and got["snpname"] == "/data/x.snp"
    assert parameters.flag(got, "inbreed") and not parameters.flag(got, "other") and parameters.number(got, "blgsize", 1) == 0.05
    for bad in ("a: 1\na: 2", "a 1", "+++ more"):
        with pytest.raises(ValueError):
            parameters.parse(bad)
    with pytest.raises(ValueError):
        parameters.parse("+++ x", lambda _: "+++ x")


def test_ped(spark, files):
    path, m, _ = files
    (path / "x.ped").write_text("f a 0 0 1 1 C C G G A A\nf b 0 0 2 2 A C 0 0 C C\n")
    assert rows(formats.read_ped(spark, str(path / "x.ped"), m)) == {("rs1", "f:a"): 0, ("rs2", "f:a"): 2, ("rs3", "f:a"): 0, ("rs1", "f:b"): 1, ("rs3", "f:b"): 2}
    assert [r.pop for r in formats.read_fam(spark, str(path / "x.ped")).orderBy("ord").collect()] == ["Control", "Case"]


def test_hash_of_ids():
    assert id_hash(["a", "b"]) == f"{(97 * 17) ^ 98:x}"


def test_streamed_block_sums(spark, tmp_path):
    terms = [(0, k % 3, float(k), 1.0) for k in range(12)]
    schema = "qid int, block int, top double, bot double"
    for k in range(2):
        spark.createDataFrame(terms[k::2], schema).write.mode("append").parquet(str(tmp_path / "in"))
    q = blocks.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).first().est == pytest.approx(5.5)


def test_positions_known_to_be_morgans_stay(spark, tmp_path):
    """Large tables have more than 100 Morgans, which in a file of unknown unit would be centimorgans."""
    (tmp_path / "far.snp").write_text("rs1 1 0.01 1000 A C\nrs2 2 240.5 2000 G T\n")
    read = lambda **k: [r.genpos for r in formats.read_snp(spark, str(tmp_path / "far.snp"), **k).orderBy("ord").collect()]
    assert read(morgans=True) == [0.01, 240.5] and read() == pytest.approx([0.0001, 2.405])


def test_lines_of_few_calls_take_little_room(spark, tmp_path):
    marker, sample = (spark.range(n).selectExpr(f"id as {c}", "id as ord") for n, c in ((200, "snp"), (20_000, "sample")))
    calls = spark.range(400).selectExpr("id % 190 as snp", "id * 7919 % 20000 as sample", "id % 3 as g")
    formats.write_eigenstrat(calls, marker, sample, str(tmp_path / "x"))
    assert sum(f.stat().st_size for f in (tmp_path / "x").iterdir()) < 200_000
    assert sorted(formats.read_eigenstrat(spark, str(tmp_path / "x"), marker, sample).collect()) == sorted(calls.collect())


def test_long_lines_reach_tasks_in_pieces(spark, tmp_path, monkeypatch):
    """Pieces of missing calls alone are left out, so a task holds a bounded part of a line, and places stay right."""
    monkeypatch.setattr(formats, "PIECE", 8)
    calls = [(0, 0, 2), (0, 7, 0), (0, 8, 1), (1, 40, 1), (3, 16, 0), (3, 41, 2)]
    for k, line in enumerate(["".join({(m, s): str(g) for m, s, g in calls}.get((m, s), "9") for s in range(42)) for m in range(4)]):
        (tmp_path / f"part-{k}").write_text(line + "\n")
    marker = spark.createDataFrame([(m, m) for m in range(4)], "snp bigint, ord bigint")
    sample = spark.createDataFrame([(s, s) for s in range(42)], "sample bigint, ord bigint")
    got = formats.read_eigenstrat(spark, str(tmp_path), marker, sample)
    assert sorted(tuple(r) for r in got.collect()) == calls
