"""Packed datasets made of single calls and read as such: byte for byte, and without what has no call."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from allelica.functions.alleles import id_hash, ordered_hash
from allelica.sources import formats, packed
from tests.test_packed import dataset, plain_file


def written(path, kind, g, order=None, frame=4):
    """A folder of one task's part, batches of 11 rows."""
    n_snp, n_ind = g.shape
    rows = g.T if kind == "TGENO" else g
    held = sorted([(k, -1) for k in range(len(rows))] + [(int(k), int(4 * at + rows[k, at])) for k, at in np.argwhere(rows < 3)])
    held = order(held) if order else held
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in b], pa.int64()), pa.array([c for _, c in b], pa.int64())], ["k", "code"]) for b in (held[a : a + 11] for a in range(0, len(held), 11))]
    writer = packed.PackedWriter({"path": path, "kind": kind, "samples": str(n_ind), "markers": str(n_snp), "samplehash": "ab", "markerhash": "cd"}, True)
    writer.frame = frame
    writer.commit([writer.write(iter(batches))])


def read(reader):
    parts = reader.partitions()
    return [x for p in parts for b in reader.read(p) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]


@pytest.mark.parametrize("missing", [0.02, 0.6, 0.99])
@pytest.mark.parametrize("kind", ["GENO", "TGENO", "BED"])
def test_frames_of_calls(tmp_path, monkeypatch, kind, missing):
    monkeypatch.setattr(packed, "GATHERED", 50)
    rng = np.random.default_rng(2)
    g = np.where(rng.random((37, 203)) < missing, 3, dataset(37, 203)).astype(np.uint8)
    g[8:17], g[:, 40:52] = 3, 3
    out = str(tmp_path / "out")
    written(out, kind, g)
    packed.single_file(out, str(tmp_path / "one"))
    assert (tmp_path / "one").read_bytes() == (plain := plain_file(g, kind))
    held = [tuple(f) for p in json.load(open(f"{out}/manifest.json"))["parts"] for f in p["frames"]]
    assert (0, 0) in held
    if kind != "TGENO":  # a row of 37 places is mostly filling
        assert any(d > 0 for _, d in held) == (missing > 0.9) and any(d < 0 for _, d in held) == (missing < 0.9)
    rows = g.T if kind == "TGENO" else g
    cells = lambda some: [(int(k), int(at), int(rows[k, at])) for k, at in np.argwhere(rows < 3) if k in some]
    every, some = set(range(len(rows))), {0, 1, 5, 6, 7, 18, 30, 33}
    options = {"path": out, "samples": "203"}
    assert read(packed.CallsReader(options)) == read(packed.CallsReader(options | {"splitbytes": "500"})) == cells(every)
    assert read(packed.CallsReader(options | {"rows": packed.range_text(list(some))})) == cells(some)
    assert read(packed.CallsReader(options | {"rows": ""})) == []
    width, head = packed.row_bytes(kind, rows.shape[1]), len(plain) - len(rows) * packed.row_bytes(kind, rows.shape[1])
    want = [(k, plain[head + k * width : head + (k + 1) * width]) for k in range(len(rows))]
    assert read(packed.PackedReader(options | {"splitbytes": "500"})) == want
    assert read(packed.PackedReader(options | {"rows": packed.range_text(list(some))})) == [want[k] for k in sorted(some)]
    # A plain file gives the same calls.
    (tmp_path / "plain").write_bytes(plain)
    assert read(packed.CallsReader({"path": str(tmp_path / "plain"), "samples": "203"})) == cells(every)


def test_rows_and_calls_that_are_not_there(tmp_path, monkeypatch):
    monkeypatch.setattr(packed, "GATHERED", 20)
    g = dataset(9, 50)
    for bad in (lambda x: [r for r in x if r != (5, -1)], lambda x: [r for r in x if r[0] != 5], lambda x: sorted([*x, (5, -1)]), lambda x: [*x, (9, 4)], lambda x: sorted([*x, (3, 4 * 50)])):
        with pytest.raises(ValueError):
            written(str(tmp_path / "bad"), "GENO", g, bad)
    # A call that is there twice counts once.
    g[4, 7] = 1
    written(str(tmp_path / "out"), "GENO", g, lambda x: sorted([*x, (4, 4 * 7 + 2), (4, 4 * 7 + 1)]))
    packed.single_file(str(tmp_path / "out"), str(tmp_path / "one"))
    assert (tmp_path / "one").read_bytes() == plain_file(g, "GENO")


def test_work_follows_the_calls(spark, tmp_path):
    """20 GB of packed rows with 3,000 calls: turned and turned back."""
    n_snp, n_ind = 200_000, 400_000
    made = spark.range(3000).select((F.col("id") * 7919 % n_snp).alias("k"), (F.col("id") * 104_729 % n_ind).alias("at"), (F.col("id") % 3).cast("int").alias("g"))
    packed.write_calls(made, spark.range(n_snp).withColumnRenamed("id", "k"), str(tmp_path / "a"), "GENO", n_ind, n_snp)
    assert packed.layout(str(tmp_path / "a")).few_calls
    formats.transpose_packed(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    formats.transpose_packed(spark, str(tmp_path / "b"), str(tmp_path / "c"))
    want = sorted(map(tuple, made.collect()))
    for name, turned in (("a", False), ("b", True), ("c", False)):
        own = packed.layout(str(tmp_path / name))
        assert (own.kind, own.rows) == (("TGENO", n_ind) if turned else ("GENO", n_snp))
        assert sum(size for part in own.frames for size, _ in part) < 200_000
        found = packed.read_calls(spark, str(tmp_path / name))
        assert found.rdd.getNumPartitions() == 1
        assert sorted((r.at, r.k, r.g) if turned else tuple(r) for r in found.collect()) == want
    one = packed.read(spark, str(tmp_path / "c"), [7919]).first()
    assert len(one.raw) == n_ind // 4 and len(packed.present(packed.matrix(pa.array([bytes(one.raw)])), n_ind)[0]) == sum(k == 7919 for k, _, _ in want)


@pytest.mark.parametrize("kind", ["GENO", "TGENO", "BED"])
def test_long_tables_are_not_sent_whole(spark, tmp_path, monkeypatch, kind):
    """Neither joined by a broadcast through the driver nor fetched by it."""
    monkeypatch.setattr(formats, "SENT_WHOLE", 20)
    marker = spark.range(60).select(F.col("id").alias("snp"), F.col("id").alias("ord"))
    sample = spark.range(30).select(F.col("id").alias("sample"), F.col("id").alias("ord"))
    g = spark.range(400).select((F.col("id") % 60).alias("snp"), (F.col("id") * 7 % 30).alias("sample"), (F.col("id") % 3).alias("g")).dropDuplicates(["snp", "sample"])
    formats.write_packed(g, marker, sample, str(tmp_path / "x"), kind)
    assert formats._wanted(marker, 60) is None and list(formats._wanted(marker.where("ord in (3, 9)"), 60)) == [3, 9]
    back = formats.read_packed(spark, str(tmp_path / "x"), marker, sample)
    assert "Broadcast" not in back._jdf.queryExecution().executedPlan().toString()
    assert sorted(back.collect()) == sorted(g.collect())
    some = formats.read_packed(spark, str(tmp_path / "x"), marker if kind == "TGENO" else marker.where("snp % 7 = 2"), sample.where("sample % 5 = 1") if kind == "TGENO" else sample, check=False)
    assert sorted(some.collect()) == sorted(g.where("sample % 5 = 1" if kind == "TGENO" else "snp % 7 = 2").collect())


def test_hash_of_ids_is_no_list(spark):
    ids = [f"I{7 * k % 101}" for k in range(101)]
    df = spark.createDataFrame(list(enumerate(ids)), "ord bigint, id string").repartition(7)
    hashed = ordered_hash(df, "id", "ord")
    assert hashed.first().hash == id_hash(ids)
    assert "collect_list" not in hashed._jdf.queryExecution().executedPlan().toString()
    assert ordered_hash(df.where("ord < 0"), "id", "ord").first().hash == "0"


def test_transposed_rows_are_made_of_calls(spark, tmp_path, monkeypatch):
    """20 GB of TGENO rows, of which a task makes those that have a call; no marker row is made on the way."""
    monkeypatch.setattr(packed, "transposed", None)
    n_snp, n_ind = 800_000, 100_000
    marker = spark.range(n_snp).select(F.col("id").alias("snp"), F.col("id").alias("ord"))
    sample = spark.range(n_ind).select(F.col("id").alias("sample"), F.col("id").alias("ord"), (F.col("id") % 500).alias("pop"))
    g = spark.range(3000).select((F.col("id") * 7919 % n_snp).alias("snp"), (F.col("id") * 13 % n_ind).alias("sample"), (F.col("id") % 3).alias("g"))
    formats.write_packed(g, marker, sample, str(tmp_path / "x"), "TGENO")
    assert sum(size for part in packed.layout(str(tmp_path / "x")).frames for size, _ in part) < 200_000
    back = formats.read_packed(spark, str(tmp_path / "x"), marker, sample.where("pop = 7"), check=False)
    assert sorted(back.collect()) == sorted(g.where("sample % 500 = 7").collect())
