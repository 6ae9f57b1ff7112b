"""Genotype file formats: text and two-bit packed, read to and written from genotype(snp, sample, g).

Text goes through Spark's reader, two-bit files through the data source of ``packed``. ``ord`` keeps file
order; genotype rows carry the marker's and the sample's place in it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelica.functions.alleles import chromosome, ordered_hash
from allelica.sources import packed
from allelica.sources.packed import BED_MAGIC as BED_MAGIC  # of the format's readers

def _lines(spark: SparkSession, path: str) -> DataFrame:
    """ord (0 on), fields and line of the lines that are not empty or comments; several files count on in the order
    of their names.

    The reader splits files as usual. A line's number is its place in its split, and the lines of the splits
    before it; these are a row for each split.
    """
    plain = F.when(F.endswith(F.col("value"), F.lit("\r")), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value"))
    rows = spark.read.text(path).select(F.rtrim(plain).alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = rows.where((F.trim("line") != "") & ~F.trim("line").startswith("#")).withColumn("id", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "start", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    numbered = rows.join(F.broadcast(splits), ["file", "start"])
    return numbered.select((F.col("id") + F.col("shift")).cast("bigint").alias("ord"), F.split(F.trim("line"), r"\s+").alias("f"), "line")


def normalised_positions(marker: DataFrame) -> DataFrame:
    """Genetic positions in Morgans: above 100 anywhere means centimorgans, all near zero means none."""
    top = marker.agg(F.max("genpos").alias("top"))
    rows = marker.join(F.broadcast(top))
    fixed = F.when(F.col("top") > 100, F.col("genpos") / 100).when(F.col("top") <= 1e-5, F.col("physpos") * 1e-8).otherwise(F.col("genpos"))
    return rows.withColumn("genpos", fixed).drop("top")


def read_snp(spark: SparkSession, path: str, morgans: bool = False) -> DataFrame:
    """snp, chrom, genpos, physpos, ref, alt, ord of a .snp file. With ``morgans`` its genetic positions are known to be
    Morgans, however large; otherwise their unit is told by their size."""
    f = F.col("f")
    rows = _lines(spark, path).where(F.size("f") >= 4)
    allele = lambda k: F.upper(F.coalesce(F.get(f, F.lit(k)), F.lit("X")))
    out = rows.select(f[0].alias("snp"), chromosome(f[1]).alias("chrom"), f[2].cast("double").alias("genpos"), f[3].cast("bigint").alias("physpos"), allele(4).alias("ref"), allele(5).alias("alt"), "ord")
    return out if morgans else normalised_positions(out)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """The same of a .map, .bim or .pedsnp file; an unknown allele 0 becomes X."""
    f = F.col("f")
    allele = lambda k: F.when(F.coalesce(F.get(f, F.lit(k)), F.lit("0")) == "0", "X").otherwise(F.upper(f[k]))
    out = _lines(spark, path).select(f[1].alias("snp"), chromosome(f[0]).alias("chrom"), f[2].cast("double").alias("genpos"), f[3].cast("bigint").alias("physpos"), allele(4).alias("ref"), allele(5).alias("alt"), "ord")
    return normalised_positions(out)


def sorted_markers(marker: DataFrame) -> DataFrame:
    return marker.orderBy("chrom", F.round(F.col("genpos") * 1e7), "physpos", "ord")


def read_ind(spark: SparkSession, path: str) -> DataFrame:
    """sample, sex, pop, ord, ignored of an .ind file."""
    f = F.col("f")
    return _lines(spark, path).select(f[0].alias("sample"), f[1].alias("sex"), f[2].alias("pop"), "ord", (f[2] == "Ignore").alias("ignored"))


def read_fam(spark: SparkSession, path: str, family_names: bool = True) -> DataFrame:
    """The same of a .fam, .pedind or .ped file: sample family:id, sex 1/2, phenotype 1 Control, 2 Case, 0, 9
    and -9 ignored, anything else a label."""
    f = F.col("f")
    label = F.when(f[5] == "1", "Control").when(f[5] == "2", "Case").otherwise(f[5])
    sex = F.when(f[4] == "1", "M").when(f[4] == "2", "F").otherwise("U")
    name = F.concat_ws(":", f[0], f[1]) if family_names else f[1]
    return _lines(spark, path).select(name.alias("sample"), sex.alias("sex"), label.alias("pop"), "ord", f[5].isin("0", "9", "-9").alias("ignored"))


#: Rows of a marker or sample table that Spark may send whole to every task.
SENT_WHOLE = 500_000


def beside(table: DataFrame, n: int) -> DataFrame:
    """A table of ``n`` rows to join calls to. A narrow column of a wide file seems small to Spark, which would send millions
    of rows whole through the driver: longer tables are shuffled with the calls."""
    return table.hint("shuffle_hash") if n > SENT_WHOLE else table


def _named(cells: DataFrame, marker: DataFrame, sample: DataFrame) -> DataFrame:
    """Cells (m, s, g) by place become calls by name; ignored samples go."""
    use = sample.where(~F.col("ignored")) if "ignored" in sample.columns else sample
    rows = cells.join(beside(marker.select(F.col("ord").alias("m"), "snp"), marker.count()), "m")
    return rows.join(beside(use.select(F.col("ord").alias("s"), "sample"), sample.count()), "s").select("snp", "sample", F.col("g").cast("bigint").alias("g"))


#: Digits of a piece of an EIGENSTRAT line.
PIECE = 1024


def read_eigenstrat(spark: SparkSession, path: str, marker: DataFrame, sample: DataFrame) -> DataFrame:
    """A line per marker, a digit per sample, 9 missing; a line that begins with X is all missing. A folder of
    ``write_eigenstrat`` is read by its frames, any other text by Spark's reader.

    There lines are cut into pieces, and those of missing calls alone are left out, so that what a task holds does not grow
    with the samples."""
    if packed.is_folder(path):
        return _named(packed.read_calls(spark, path).select(F.col("k").alias("m"), F.col("at").alias("s"), "g"), marker, sample)
    lines = _lines(spark, path).where(~F.col("line").startswith("X"))
    digits = F.trim("line").cast("binary")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("digits") - 1) / PIECE).cast("int")), lambda k: F.substring(F.col("digits"), k * PIECE + 1, F.lit(PIECE)))
    pieces = lines.select(F.col("ord").alias("m"), digits.alias("digits")).select("m", F.posexplode(cut).alias("k", "piece")).where(F.col("piece") != F.lit(b"9" * PIECE))

    def run(batches):
        for b in batches:
            piece, m, k = b.column("piece"), b.column("m").to_numpy(), b.column("k").to_numpy()
            ends = np.frombuffer(piece.buffers()[1], dtype=np.int32)[piece.offset : piece.offset + len(piece) + 1]
            digits = np.frombuffer(piece.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] - 48 if ends[-1] > ends[0] else np.zeros(0, dtype=np.uint8)
            at = np.flatnonzero(digits < 3)
            row = np.searchsorted(ends - ends[0], at, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(m[row]), pa.array(at - (ends - ends[0])[row] + k[row].astype(np.int64) * PIECE), pa.array(digits[at].astype(np.int32))], ["m", "s", "g"])

    cells = pieces.mapInArrow(run, "m bigint, s bigint, g int")
    return _named(cells, marker, sample)


def read_ancestrymap(spark: SparkSession, path: str) -> DataFrame:
    """Lines of marker, sample, count; a missing call has no line."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("snp"), parts[1].alias("sample"), parts[2].cast("bigint").alias("g")).where("g between 0 and 2")


def read_ped(spark: SparkSession, path: str, marker: DataFrame, family_names: bool = True) -> DataFrame:
    """Two allele columns per marker after six of the sample; calls count the marker's first allele."""
    f = F.col("f")
    name = F.concat_ws(":", f[0], f[1]) if family_names else f[1]
    letters = F.create_map(*[F.lit(x) for p in ("1A", "2C", "3G", "4T") for x in p])
    one = lambda x: F.coalesce(letters[x], F.upper(x))
    rows = _lines(spark, path).select(name.alias("sample"), F.posexplode(F.slice(f, 7, 1 << 30)).alias("k", "a"))
    rows = rows.select("sample", F.floor(F.col("k") / 2).alias("m"), one(F.col("a")).alias("a")).join(marker.select(F.col("ord").alias("m"), "snp", "ref", "alt"), "m")
    counted = rows.where("a = ref or a = alt").groupBy("snp", "sample").agg(F.sum((F.col("a") == F.col("ref")).cast("bigint")).alias("g"), F.count("*").alias("n"))
    return counted.where("n = 2").select("snp", "sample", "g")


def _wanted(rows: DataFrame, held: int) -> np.ndarray | None:
    """The places of a sample or marker table, where they are fewer than a file's rows: eight bytes for each. A whole
    table's are not fetched."""
    return rows.select("ord").toArrow().column("ord").to_numpy() if rows.count() < held else None


def read_packed(spark: SparkSession, path: str, marker: DataFrame, sample: DataFrame, check: bool = True) -> DataFrame:
    """Calls of a packed GENO, transposed TGENO or BED file or folder, by its header; with ``check`` the header's counts
    and id hashes must be those of the marker and sample tables. Without it the tables may be parts of the dataset's, and
    only their rows of the file are read: samples' of a TGENO file, markers' of the others."""
    own = packed.layout(path, sample.count())
    if check and own.kind != "BED":
        found = [(t.count(), ordered_hash(t, c, "ord").first()["hash"]) for t, c in ((sample, "sample"), (marker, "snp"))]
        if found != [(own.n_ind, own.hashes[0]), (own.n_snp, own.hashes[1])]:
            raise ValueError("the header does not fit the marker and sample tables")
    use = sample.where(~F.col("ignored")) if "ignored" in sample.columns else sample
    wanted = _wanted(use if own.kind == "TGENO" else marker, own.rows)
    k, at = ("s", "m") if own.kind == "TGENO" else ("m", "s")
    cells = packed.read_calls(spark, path, wanted, own.n_ind)
    return _named(cells.select(F.col("k").alias(k), F.col("at").alias(at), "g"), marker, sample)


def read_bed(spark: SparkSession, path: str, marker: DataFrame, sample: DataFrame) -> DataFrame:
    return read_packed(spark, path, marker, sample)


def wide_rows(genotype: DataFrame, marker: DataFrame, sample: DataFrame) -> DataFrame:
    """ord, snp, codes: a row per marker with an array of calls in sample order, null where missing."""
    n = sample.count()
    rows = genotype.join(sample.select("sample", F.col("ord").cast("int").alias("s")), "sample")
    per = rows.groupBy("snp").agg(F.array_sort(F.collect_list(F.struct("s", "g"))).alias("w"))
    # Calls in order with nulls in the gaps before each and after the last.
    gap = lambda k: F.array_repeat(F.lit(None).cast("bigint"), k)
    before = lambda k: F.coalesce(F.get("w", k)["s"], F.lit(-1))
    held = F.flatten(F.transform("w", lambda x, k: F.concat(gap(x["s"] - before(k - 1) - 1), F.array(x["g"].cast("bigint")))))
    codes = F.when(F.col("w").isNull(), gap(F.lit(n))).otherwise(F.concat(held, gap(n - 1 - before(F.size("w") - 1))))
    return marker.select("snp", "ord").join(per, "snp", "left").select("ord", "snp", codes.alias("codes"))


def eigenstrat_lines(genotype: DataFrame, marker: DataFrame, sample: DataFrame) -> DataFrame:
    """A line per marker, in order: calls are dealt, and a line is made of its calls and the gaps between them."""
    n, markers = sample.count(), marker.count()
    rows = genotype.join(sample.select("sample", F.col("ord").cast("int").alias("s")), "sample")
    per = rows.groupBy("snp").agg(F.array_sort(F.collect_list(F.struct("s", F.col("g").cast("int").alias("g")))).alias("w"))
    ordered = packed.dealt_by(marker.select("snp", "ord").join(per, "snp", "left").select("ord", "w"), "ord", markers, n)
    gap = lambda k: F.repeat(F.lit("9"), k)
    before = lambda k: F.coalesce(F.get("w", k)["s"], F.lit(-1))
    held = F.array_join(F.transform("w", lambda x, k: F.concat(gap(x["s"] - before(k - 1) - 1), x["g"].cast("string"))), "")
    line = F.when(F.col("w").isNull(), gap(F.lit(n))).otherwise(F.concat(held, gap(n - 1 - before(F.size("w") - 1))))
    return ordered.select(line.alias("value"))


def write_eigenstrat(genotype: DataFrame, marker: DataFrame, sample: DataFrame, path: str) -> None:
    """A folder of text parts, compressed by zstd, whose order is the markers': a line has a digit for every sample, called
    or not, and its length is known, so lines are made of the calls as they come. ``packed.single_file`` makes plain text of
    it."""
    n_ind, n_snp = sample.count(), marker.count()
    packed.write_calls(_places(genotype, marker, sample, "m", "s"), marker.select(F.col("ord").alias("k")), path, packed.TEXT, n_ind, n_snp)


def write_ancestrymap(genotype: DataFrame, path: str) -> None:
    genotype.select(F.concat_ws(" ", F.col("snp").cast("string"), F.col("sample").cast("string"), F.col("g").cast("string")).alias("value")).write.text(path)


def packed_rows(genotype: DataFrame, marker: DataFrame, sample: DataFrame, kind: str = "geno") -> DataFrame:
    """ord, raw: the rows of a GENO or BED file in marker order."""
    cells = genotype.join(marker.select("snp", F.col("ord").alias("k")), "snp").join(sample.select("sample", F.col("ord").alias("at")), "sample")
    rows = packed.packed_calls(cells.select("k", "at", "g"), marker.select(F.col("ord").alias("k")), sample.count(), kind.upper())
    return rows.withColumnRenamed("k", "ord")  # in order


def _places(genotype: DataFrame, marker: DataFrame, sample: DataFrame, k: str, at: str) -> DataFrame:
    """k, at, g: calls by places of markers m and samples s."""
    own = beside(marker.select("snp", F.col("ord").alias("m")), marker.count()), beside(sample.select("sample", F.col("ord").alias("s")), sample.count())
    return genotype.join(own[0], "snp").join(own[1], "sample").select(F.col(k).alias("k"), F.col(at).alias("at"), "g")


def write_packed(genotype: DataFrame, marker: DataFrame, sample: DataFrame, path: str, kind: str = "GENO") -> None:
    """A folder of packed parts (GENO, TGENO or BED) with the id hashes of the tables, whose ``ord`` count from 0."""
    kind = kind.upper()
    n_ind, n_snp = sample.count(), marker.count()
    (k, rows), at = ((("s", sample), "m") if kind == "TGENO" else (("m", marker), "s"))
    hashes = [ordered_hash(t, c, "ord").first()["hash"] for t, c in ((sample, "sample"), (marker, "snp"))]
    packed.write_calls(_places(genotype, marker, sample, k, at), rows.select(F.col("ord").alias("k")), path, kind, n_ind, n_snp, tuple(hashes))


def transpose_packed(spark: SparkSession, path: str, out: str) -> None:
    """A GENO dataset as a TGENO folder, or the other way: where calls are few they change places one by one, otherwise
    two-bit tiles are exchanged and nothing is unpacked."""
    own = packed.layout(path)
    kind = {"GENO": "TGENO", "TGENO": "GENO"}.get(own.kind)
    if kind is None:
        raise ValueError("only GENO and TGENO are each other's transposes")
    if own.few_calls:
        cells = packed.read_calls(spark, path).select(F.col("at").alias("k"), F.col("k").alias("at"), "g")
        packed.write_calls(cells, spark.range(own.columns).withColumnRenamed("id", "k"), out, kind, own.n_ind, own.n_snp, own.hashes)
        return
    turned = packed.transposed(packed.read(spark, path), own.rows, own.columns, packed.row_bytes(kind, own.rows))
    packed.write(turned, out, kind, own.n_ind, own.n_snp, own.hashes, dealt=True)


def packed_header(kind: str, marker: DataFrame, sample: DataFrame) -> bytes:
    inds, snps = ((t.count(), ordered_hash(t, c, "ord").first()["hash"]) for t, c in ((sample, "sample"), (marker, "snp")))
    return packed.header(kind, inds[0], snps[0], inds[1], snps[1])


def transposed_rows(genotype: DataFrame, marker: DataFrame, sample: DataFrame) -> DataFrame:
    """ord, raw: the rows of a TGENO file in sample order."""
    turned = genotype.select(F.col("sample").alias("snp"), F.col("snp").alias("sample"), "g")
    names = lambda t, old, new: t.select(F.col(old).alias(new), "ord")
    return packed_rows(turned, names(sample, "sample", "snp"), names(marker, "snp", "sample"))


def ped_lines(genotype: DataFrame, marker: DataFrame, sample: DataFrame) -> DataFrame:
    """A line per sample: family, id, two zeros, sex, phenotype or label, and two alleles a marker; 0 is missing."""
    own = marker.select(F.col("snp").alias("sample"), "ord", "ref", "alt")
    turned = genotype.select(F.col("sample").alias("snp"), F.col("snp").alias("sample"), "g")
    wide = wide_rows(turned, sample.select(F.col("sample").alias("snp"), "ord"), own.select("sample", "ord"))
    # A row per marker, in the order of the wide rows' places; one value, as in the file's every line.
    letters = own.agg(F.array_sort(F.collect_list(F.struct("ord", "ref", "alt"))).alias("letters"))
    pair = lambda g, x: F.when(g == 2, F.concat_ws(" ", x["ref"], x["ref"])).when(g == 1, F.concat_ws(" ", x["ref"], x["alt"])).when(g == 0, F.concat_ws(" ", x["alt"], x["alt"])).otherwise("0 0")
    rows = wide.join(F.broadcast(letters), F.lit(True)).join(sample.select(F.col("sample").alias("snp"), "sex", "pop"), "snp")
    calls = F.array_join(F.zip_with("codes", "letters", pair), " ")
    name = F.split(F.col("snp").cast("string"), ":")
    family = F.when(F.size(name) > 1, name[0]).otherwise(F.col("snp").cast("string"))
    sex = F.when(F.col("sex") == "M", "1").when(F.col("sex") == "F", "2").otherwise("0")
    label = F.when(F.col("pop") == "Control", "1").when(F.col("pop") == "Case", "2").otherwise(F.col("pop").cast("string"))
    return rows.orderBy("ord").select(F.concat_ws(" ", family, F.element_at(name, -1), F.lit("0"), F.lit("0"), sex, label, calls).alias("value"))


def write_ped(genotype: DataFrame, marker: DataFrame, sample: DataFrame, path: str) -> None:
    """A folder of text parts whose order is the samples'."""
    ped_lines(genotype, marker, sample).write.text(path)


def snp_lines(marker: DataFrame) -> DataFrame:
    """Lines of a .snp file in file order."""
    return marker.orderBy("ord").select(F.concat_ws("\t", F.col("snp").cast("string"), F.col("chrom").cast("string"), F.format_string("%.6f", F.col("genpos").cast("double")), F.col("physpos").cast("string"), "ref", "alt").alias("value"))


def ind_lines(sample: DataFrame) -> DataFrame:
    return sample.orderBy("ord").select(F.concat_ws("\t", F.col("sample").cast("string"), "sex", F.col("pop").cast("string")).alias("value"))


def read_genotype_list(parts: list[DataFrame]) -> DataFrame:
    """Calls of several genotype files over one marker set: each has samples of its own."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_probabilities(spark: SparkSession, path: str, marker: DataFrame, sample: DataFrame) -> DataFrame:
    """snp, sample, p: the probabilities of 0, 1 and 2 reference alleles. A cell is two 16-bit numbers, the first
    and the last of them times 65535, cells of a marker in sample order; both at 65535 is missing."""
    n = sample.count()

    def run(frames):
        for pdf in frames:
            out = []
            for k, raw in zip(pdf["k"], pdf["raw"], strict=True):
                x = np.frombuffer(raw, dtype="<u2").reshape(-1, 2)[:n] / 65535.0
                at = np.flatnonzero(~((x[:, 0] == 1) & (x[:, 1] == 1)))
                p = np.column_stack([x[at, 0], 1 - x[at, 0] - x[at, 1], x[at, 1]])
                out.append(pd.DataFrame({"m": np.full(len(at), k), "s": at, "p": list(p)}))
            yield pd.concat(out) if out else pd.DataFrame({"m": [], "s": [], "p": []})

    raw = spark.sparkContext.binaryRecords(path, 4 * n).zipWithIndex().map(lambda x: (x[1], bytearray(x[0])))
    cells = spark.createDataFrame(raw, "k bigint, raw binary").mapInPandas(run, "m bigint, s bigint, p array<double>")
    rows = cells.join(marker.select(F.col("ord").alias("m"), "snp"), "m").join(sample.select(F.col("ord").alias("s"), "sample"), "s")
    return rows.select("snp", "sample", "p")


def probability_rows(probabilities: DataFrame, marker: DataFrame, sample: DataFrame) -> DataFrame:
    """ord, raw: the rows of such a file in marker order."""
    n = sample.count()

    def run(frames):
        for pdf in frames:
            raws = []
            for cells in pdf["cells"]:
                x = np.full((n, 2), 65535, dtype="<u2")
                for c in cells if cells is not None else ():
                    p = np.asarray(c["p"]) / np.sum(c["p"])
                    x[c["s"]] = np.rint(65535 * p[[0, 2]])
                raws.append(x.tobytes())
            yield pd.DataFrame({"ord": pdf["ord"], "raw": raws})

    own = probabilities.join(sample.select("sample", F.col("ord").cast("int").alias("s")), "sample").groupBy("snp").agg(F.collect_list(F.struct("s", "p")).alias("cells"))
    return marker.select("snp", "ord").join(own, "snp", "left").select("ord", "cells").mapInPandas(run, "ord bigint, raw binary").orderBy("ord")


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """snp, value of a file of marker weights or values; markers that are not in it are dropped by the join."""
    f = F.col("f")
    return _lines(spark, path).select(f[0].alias("snp"), f[1].cast("double").alias("value"))


def value_lines(values: DataFrame) -> DataFrame:
    return values.orderBy("snp").select(F.concat_ws(" ", F.col("snp").cast("string"), F.format_string("%.6f", "value")).alias("value"))


def read_list(spark: SparkSession, path: str, typed: bool = False) -> list:
    """The first words of a population list, or with ``typed`` its (word, number) pairs; a repeat is refused."""
    rows = [r.f for r in _lines(spark, path).orderBy("ord").collect()]
    if typed and any(len(r) < 2 for r in rows):
        raise ValueError("a typed list needs two columns")
    names = [r[0] for r in rows]
    if len(set(names)) < len(names):
        raise ValueError("a population is listed twice")
    return [(r[0], int(r[1])) for r in rows] if typed else names


def phylip_lines(matrix: DataFrame, pops: list, value: str = "fst") -> DataFrame:
    """A PHYLIP distance matrix from rows (a, b, value): the number of populations, then a line for each."""
    both = matrix.select("a", "b", value).unionByName(matrix.select(F.col("b").alias("a"), F.col("a").alias("b"), value))
    own = both.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", value))).alias("m"))
    place = F.array_position(F.array(*map(F.lit, pops)), F.col("a")).cast("int")
    cells = [F.format_string("%.6f", F.coalesce(F.try_element_at("m", F.lit(p)), F.lit(0.0))) for p in pops]
    lines = own.select(place.alias("k"), F.concat_ws(" ", F.rpad(F.col("a").cast("string"), 10, " "), *cells).alias("value"))
    head = matrix.sparkSession.createDataFrame([(0, str(len(pops)))], "k int, value string")
    return head.unionByName(lines).orderBy("k").select("value")


def spectrum_lines(spectrum: DataFrame, sizes: dict) -> DataFrame:
    """A spectrum file from rows (k0, k1, ..., share, se): a head, the populations with their sizes, and a line for each
    configuration under its number, the last population's count running fastest. Configurations without a row have
    share 0, and no error is below the least that is not 0."""
    n, places = 1, F.lit(0).cast("bigint")
    for k, size in enumerate(sizes.values()):
        n, places = n * (size + 1), places * (size + 1) + F.col(f"k{k}")
    spark = spectrum.sparkSession
    rows = spark.range(n).join(spectrum.select(places.alias("id"), "share", "se"), "id", "left")
    least = F.broadcast(spectrum.agg(F.min(F.when(F.col("se") > 0, F.col("se"))).alias("least")))  # one row
    counts, step = [], n
    for size in sizes.values():
        step //= size + 1
        counts.append(F.lpad(F.pmod(F.floor(F.col("id") / step), F.lit(size + 1)).cast("string"), 5, " "))
    shown = [F.format_string("%15.9f", F.coalesce(c, F.lit(0.0))) for c in (F.col("share"), F.greatest("se", "least"))]
    lines = rows.join(least).select(F.col("id").alias("k"), F.concat_ws(" ", F.lit("spec:"), F.concat(F.lpad(F.col("id").cast("string"), 5, " "), F.lit(":")), *counts, F.lit(""), *shown).alias("value"))
    names = "; ".join(f" {p} :: {size} " for p, size in sizes.items())
    head = spark.createDataFrame([(-2, "newformat:"), (-1, "sampsizes: " + names)], "k bigint, value string")
    return head.unionByName(lines).orderBy("k").select("value")


def read_spectrum(spark: SparkSession, path: str, width: int) -> DataFrame:
    """k0, k1, ..., share, se of a spectrum file of ``width`` populations; an ascertained count a:b is a + b."""
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.col("value").startswith("spec:")).select(words.alias("w"))
    whole = lambda c: F.aggregate(F.split(c, ":"), F.lit(0), lambda a, x: a + x.cast("int"))
    return lines.select(*[whole(F.col("w")[k + 2]).alias(f"k{k}") for k in range(width)], F.col("w")[width + 2].cast("double").alias("share"), F.col("w")[width + 3].cast("double").alias("se"))


def result_lines(results: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """``result:`` lines of some columns, numbers with fixed digits."""
    kinds = dict(results.dtypes)
    shown = [F.format_string(f"%.{digits}f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in columns]
    return results.select(F.concat_ws(" ", F.lit("result:"), *shown).alias("value"))
