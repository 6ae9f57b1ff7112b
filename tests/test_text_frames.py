"""EIGENSTRAT folders: all digits, in compressed lines of one length."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from allelica.plans import front
from allelica.sources import formats, packed
from tests.test_packed import dataset
from tests.test_packed_calls import read, written


@pytest.mark.parametrize("missing", [0.02, 0.6, 0.99])
def test_lines_of_digits(tmp_path, monkeypatch, missing):
    monkeypatch.setattr(packed, "GATHERED", 50)
    rng = np.random.default_rng(2)
    g = np.where(rng.random((37, 203)) < missing, 3, dataset(37, 203)).astype(np.uint8)
    g[8:17] = 3
    out = str(tmp_path / "out")
    written(out, "EIGENSTRAT", g)
    plain = "".join("".join("0129"[x] for x in row) + "\n" for row in g).encode()
    packed.single_file(out, str(tmp_path / "one"))
    assert (tmp_path / "one").read_bytes() == plain
    # Parts are zstd text without the manifest, too, and every line is in them.
    parts = sorted((tmp_path / "out").glob("part-*.zst"))
    assert b"".join(pa.input_stream(str(f), compression="zstd").read() for f in parts) == plain
    assert all(differ == -1 for p in json.load(open(f"{out}/manifest.json"))["parts"] for _, differ in p["frames"])
    cells = lambda some: [(int(k), int(at), int(g[k, at])) for k, at in np.argwhere(g < 3) if k in some]
    options, some = {"path": out}, {0, 1, 5, 6, 7, 18, 30, 33}
    assert read(packed.CallsReader(options)) == read(packed.CallsReader(options | {"splitbytes": "50"})) == cells(set(range(37)))
    assert len(packed.CallsReader(options | {"splitbytes": "50"}).partitions()) > 3
    assert read(packed.CallsReader(options | {"rows": packed.range_text(list(some))})) == cells(some)
    assert read(packed.PackedReader(options)) == [(k, plain[204 * k : 204 * (k + 1)]) for k in range(37)]


def test_lines_of_another_length():
    assert [x.tolist() for x in packed.digits(np.frombuffer(b"9902\n9199\n", dtype=np.uint8), 5)] == [[0, 0, 1], [2, 3, 1], [0, 2, 1]]
    for bad in (b"9902\n919\n9", b"990\n29199\n", b"9902\n91999", b"9902\n9199"):
        with pytest.raises(ValueError):
            packed.digits(np.frombuffer(bad, dtype=np.uint8), 5)


def test_wide_lines_go_by_frames(spark, tmp_path):
    """3 GB of digits with 2,000 calls: written and read without a piece of text in Spark's rows."""
    n_snp, n_ind = 20_000, 150_000
    marker = spark.range(n_snp).select(F.col("id").alias("snp"), F.col("id").alias("ord"))
    sample = spark.range(n_ind).select(F.col("id").alias("sample"), F.col("id").alias("ord"))
    g = spark.range(2000).select((F.col("id") * 7919 % n_snp).alias("snp"), (F.col("id") * 13 % n_ind).alias("sample"), (F.col("id") % 3).alias("g"))
    formats.write_eigenstrat(g, marker, sample, str(tmp_path / "x"))
    assert packed.layout(str(tmp_path / "x")).row == n_ind + 1
    back = formats.read_eigenstrat(spark, str(tmp_path / "x"), marker, sample)
    assert "Generate" not in back._jdf.queryExecution().executedPlan().toString()
    assert sorted(back.collect()) == sorted(g.collect())


@pytest.mark.parametrize("kind", ["EIGENSTRAT", "GENO", "BED"])
def test_a_folder_is_known_by_its_manifest(spark, tmp_path, kind):
    marker = spark.range(9).select(F.col("id").alias("snp"), F.col("id").alias("ord"))
    sample = spark.range(30).select(F.col("id").alias("sample"), F.col("id").alias("ord"))
    g = spark.range(200).select((F.col("id") % 9).alias("snp"), (F.col("id") % 29).alias("sample"), (F.col("id") % 3).alias("g")).dropDuplicates(["snp", "sample"])
    path = str(tmp_path / "x")
    formats.write_eigenstrat(g, marker, sample, path) if kind == "EIGENSTRAT" else formats.write_packed(g, marker, sample, path, kind)
    assert sorted(front.genotype(spark, path, marker, sample).collect()) == sorted(g.collect())
