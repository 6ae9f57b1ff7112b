"""The packed data source, its writer's commit, and transposition, byte for byte."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelica.sources import packed


def dataset(n_snp, n_ind, seed=0):
    return np.random.default_rng(seed).integers(0, 4, (n_snp, n_ind)).astype(np.uint8)


def plain_row(codes, width, bed=False):
    out = bytearray(width)
    for i, c in enumerate(codes):
        code = {2: 0, 3: 1, 1: 2, 0: 3}[int(c)] if bed else int(c)
        out[i // 4] |= code << (2 * (i % 4) if bed else 6 - 2 * (i % 4))
    return bytes(out)


def plain_file(g, kind):
    """The bytes of a packed file of markers by samples."""
    m, n = g.shape
    rows = g.T if kind == "TGENO" else g
    width = packed.row_bytes(kind, rows.shape[1])
    head = packed.BED_MAGIC if kind == "BED" else f"{kind} {n:7d} {m:7d} ab cd".encode().ljust(48 if kind == "TGENO" else width, b"\0")
    return head + b"".join(plain_row(r, width, kind == "BED") for r in rows)


def made(tmp_path, kind, n_snp=37, n_ind=203):
    g = dataset(n_snp, n_ind)
    path = str(tmp_path / f"x.{kind.lower()}")
    with open(path, "wb") as f:
        f.write(plain_file(g, kind))
    return g, path


@pytest.mark.parametrize("kind", ["GENO", "TGENO", "BED"])
def test_read_in_splits(spark, tmp_path, kind):
    g, path = made(tmp_path, kind)
    packed.read(spark, path, samples=203).count()
    rows = spark.read.format("packed").options(samples=203, splitBytes=500).load(path)
    assert rows.rdd.getNumPartitions() > 4
    own = packed.layout(path, 203)
    assert (own.kind, own.n_ind, own.n_snp, own.rows) == (kind, 203, 37, 203 if kind == "TGENO" else 37)
    got = {(r.m, r.s): r.g for r in packed.calls(rows, kind, own.columns, cells=1000).collect()}
    assert got == {(i, j): int(g[i, j]) for i in range(37) for j in range(203) if g[i, j] < 3}


def test_only_wanted_rows_are_read(spark, tmp_path):
    g, path = made(tmp_path, "TGENO")
    plain = plain_file(g, "TGENO")
    want = [0, 1, 2, 77, 150, 151, 202]
    got = {r.k: bytes(r.raw) for r in packed.read(spark, path, want).collect()}
    assert got == {k: plain[48 * (k + 1) : 48 * (k + 2)] for k in want}
    reader = packed.PackedReader({"path": path, "rows": packed.range_text(want)})
    parts = reader.partitions()
    assert sum(n for p in parts for _, _, n, _ in p.runs) == len(want) and len(parts[0].runs) == 4
    # The bytes that are read fall with the filter, pushed or as an option.
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

    reader = packed.PushedReader({"path": path})
    left = list(reader.pushFilters([GreaterThan(("k",), 100), LessThanOrEqual(("k",), 160), In(("k",), (5, 120, 121, 160, 161)), StringContains(("raw",), "x")]))
    assert [type(f) for f in left] == [StringContains] and reader.wanted == [(120, 122), (160, 161)]
    assert list(reader.pushFilters([EqualTo(("k",), 5)])) == [] and reader.wanted == [] and list(reader.read(reader.partitions()[0])) == []
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = packed.read(spark, path).where("k >= 10 and k < 13")
        assert sorted(r.k for r in df.collect()) == [10, 11, 12]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert packed.read(spark, path, []).count() == 0


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file: only what is asked for is read."""
    path, n_ind, n_snp = str(tmp_path / "big.tgeno"), 3000, 4_000_000
    with open(path, "wb") as f:
        f.write(f"TGENO {n_ind:7d} {n_snp:7d} ab cd".encode().ljust(48, b"\0"))
        f.seek(48 + 2999 * 1_000_000)
        f.write(b"\x1b" * 1_000_000)
    assert os.path.getsize(path) > 2**31
    df = packed.read(spark, path)
    assert df.rdd.getNumPartitions() > 40
    last = packed.read(spark, path, [0, 2999])
    assert {r.k: r.n for r in packed.calls(last, "TGENO", n_snp).groupBy(F.col("s").alias("k")).agg(F.countDistinct("g").alias("n")).collect()} == {0: 1, 2999: 3}


def test_broken_files(spark, tmp_path):
    g, path = made(tmp_path, "GENO")
    (tmp_path / "short.geno").write_bytes(plain_file(g, "GENO")[:-1])
    (tmp_path / "other").write_bytes(b"hello")
    for bad in ("short.geno", "other"):
        with pytest.raises(ValueError):
            packed.layout(str(tmp_path / bad))
    with pytest.raises(FileNotFoundError):
        packed.layout(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        packed.layout(made(tmp_path, "BED")[1])


@pytest.mark.parametrize("kind", ["GENO", "TGENO", "BED"])
def test_write_and_read_again(spark, tmp_path, kind):
    g, path = made(tmp_path, kind)
    rows = packed.read(spark, path, samples=203).orderBy(F.rand(1))
    packed.write(rows.repartition(5), str(tmp_path / "out"), kind, 203, 37, ("ab", "cd"))
    packed.single_file(str(tmp_path / "out"), str(tmp_path / "one"))
    assert (tmp_path / "one").read_bytes() == plain_file(g, kind)
    again = packed.read(spark, str(tmp_path / "out"), samples=203)
    assert {r.k: r.raw for r in again.collect()} == {r.k: r.raw for r in rows.collect()}
    some = packed.read(spark, str(tmp_path / "out"), [3, 30])
    assert sorted(r.k for r in some.collect()) == [3, 30]
    with pytest.raises(Exception, match="FileExists"):
        packed.write(rows, str(tmp_path / "out"), kind, 203, 37)


def test_failed_attempts_leave_nothing(spark, tmp_path):
    g, path = made(tmp_path, "GENO")
    rows, out = packed.read(spark, path), str(tmp_path / "out")
    for bad in (rows.where("k <> 5"), rows.unionAll(rows.where("k = 5")), rows.withColumn("raw", F.when(F.col("k") == 9, F.lit(b"x")).otherwise(F.col("raw"))), rows.where("k < 30")):
        with pytest.raises(Exception):
            packed.write(bad, out, "GENO", 203, 37)
        assert not os.path.exists(out) or not os.listdir(out)
    # A part of an attempt that was killed after it wrote, and its repetition.
    writer = packed.PackedWriter({"path": out, "kind": "GENO", "samples": "203", "markers": "37"}, True)
    batches = rows.orderBy("k").toArrow().combine_chunks().to_batches()
    killed, first = writer.write(iter(batches)), writer.write(iter(batches))
    assert killed.name != first.name and len(os.listdir(out)) == 2
    writer.commit([first, packed.Part("", -1, 0), None])
    assert sorted(os.listdir(out)) == sorted([first.name, "header.bin", "manifest.json"])
    assert [p["name"] for p in json.load(open(f"{out}/manifest.json"))["parts"]] == [first.name]
    assert packed.read(spark, out).count() == 37


@pytest.mark.parametrize("tile", [(4096, 64 << 20), (8, 37 * 4 * 5), (3, 1)], ids=str)
def test_transposition(spark, tmp_path, tile):
    g, path = made(tmp_path, "GENO", 61, 203)
    turned = packed.transposed(packed.read(spark, path).repartition(3), 61, 203, packed.row_bytes("TGENO", 61), *tile)
    packed.write(turned, str(tmp_path / "t"), "TGENO", 203, 61, ("ab", "cd"))
    packed.single_file(str(tmp_path / "t"), str(tmp_path / "t.one"))
    assert (tmp_path / "t.one").read_bytes() == plain_file(g, "TGENO")
    back = packed.transposed(packed.read(spark, str(tmp_path / "t")), 203, 61, packed.row_bytes("GENO", 203), *tile)
    packed.write(back, str(tmp_path / "b"), "GENO", 203, 61, ("ab", "cd"))
    packed.single_file(str(tmp_path / "b"), str(tmp_path / "b.one"))
    assert (tmp_path / "b.one").read_bytes() == plain_file(g, "GENO")


@pytest.mark.parametrize("kind", ["GENO", "BED"])
def test_packed_calls(spark, kind):
    g = dataset(9, 203)
    cells = spark.createDataFrame([(i, j, int(g[i, j])) for i in range(9) for j in range(203) if g[i, j] < 3 and i != 4], "k bigint, at bigint, g bigint")
    got = {r.k: bytes(r.raw) for r in packed.packed_calls(cells, spark.range(9).withColumnRenamed("id", "k"), 203, kind).collect()}
    g[4] = 3
    assert got == {i: plain_row(g[i], packed.row_bytes(kind, 203), kind == "BED") for i in range(9)}


def test_missing_calls_cost_little(spark, tmp_path):
    """A wide dataset of few calls: small on disk, turned by its calls, and plain again as one file."""
    g = np.full((300, 40_001), 3, dtype=np.uint8)
    rng = np.random.default_rng(4)
    g[rng.integers(0, 300, 900), rng.integers(0, 40_001, 900)] = rng.integers(0, 3, 900)
    g[7] = 3
    (tmp_path / "x.geno").write_bytes(plain := plain_file(g, "GENO"))
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / name).iterdir())
    packed.write(packed.transposed(packed.read(spark, str(tmp_path / "x.geno")), 300, 40_001, packed.row_bytes("TGENO", 300)), str(tmp_path / "t"), "TGENO", 40_001, 300, ("ab", "cd"), dealt=True)
    packed.write(packed.transposed(packed.read(spark, str(tmp_path / "t")), 40_001, 300, packed.row_bytes("GENO", 40_001)), str(tmp_path / "b"), "GENO", 40_001, 300, ("ab", "cd"), dealt=True)
    packed.single_file(str(tmp_path / "b"), str(tmp_path / "one"))
    assert (tmp_path / "one").read_bytes() == plain
    assert size("t") < 100_000 and size("b") < 100_000 < len(plain)
    got = {(r.m, r.s): r.g for r in packed.calls(packed.read(spark, str(tmp_path / "t"), [0, 17, 40_000]), "TGENO", 300).collect()}
    assert got == {(i, j): int(g[i, j]) for i in range(300) for j in (0, 17, 40_000) if g[i, j] < 3}
