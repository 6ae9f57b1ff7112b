"""Converter transforms over genotype(snp, sample, g). Random ones hash (marker, sample, seed), so reruns and
other partitionings give the same calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coin(seed: int, *keys: str) -> Column:
    """A uniform number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*(keys or ("snp", "sample")), F.lit(seed)), 11) / F.lit(float(1 << 53))


def hets_to(genotype: DataFrame, how: str = "missing", seed: int = 0) -> DataFrame:
    """Heterozygotes become 2, a random homozygote, or missing."""
    if how == "missing":
        return genotype.where("g <> 1")
    value = F.lit(2) if how == "reference" else F.when(coin(seed) < 0.5, 0).otherwise(2)
    return genotype.withColumn("g", F.when(F.col("g") == 1, value).otherwise(F.col("g")).cast("bigint"))


def flip(genotype: DataFrame, listed: DataFrame) -> DataFrame:
    """2 - g at the listed markers."""
    marks = listed.select("snp").distinct().withColumn("f", F.lit(True))
    return genotype.join(marks, "snp", "left").select("snp", "sample", F.when(F.col("f"), 2 - F.col("g")).otherwise(F.col("g")).alias("g"))


def polarize(genotype: DataFrame, sample) -> DataFrame:
    """Markers at which the sample is homozygous, turned so that it has the reference allele twice."""
    own = genotype.where((F.col("sample") == sample) & (F.col("g") != 1)).select("snp", F.col("g").alias("own"))
    return genotype.join(own, "snp").select("snp", "sample", F.when(F.col("own") == 0, 2 - F.col("g")).otherwise(F.col("g")).alias("g"))


def fill_missing(genotype: DataFrame, sample: DataFrame, marker: DataFrame, seed: int = 0) -> DataFrame:
    """Every missing call is drawn from its population's frequency: two alleles with that chance each.

    The grid of absent cells is samples times markers by definition of the result. Markers without data in
    a population stay missing there.
    """
    per = genotype.join(sample.select("sample", "pop"), "sample").groupBy("snp", "pop").agg((F.sum("g") / (2 * F.count("*"))).alias("p"))
    members = sample.groupBy("pop").agg(F.collect_list("sample").alias("members"))
    grid = per.join(marker.select("snp"), "snp", "left_semi").join(members, "pop").select("snp", "p", F.explode("members").alias("sample"))
    drawn = (coin(seed) < F.col("p")).cast("bigint") + (coin(seed + 1) < F.col("p")).cast("bigint")
    return grid.join(genotype, ["snp", "sample"], "left").select("snp", "sample", F.coalesce("g", drawn).alias("g"))


def force_missing(genotype: DataFrame, share: float, seed: int = 0) -> DataFrame:
    return genotype.where(coin(seed) >= share)


def shuffle_samples(genotype: DataFrame, sample: DataFrame, seed: int = 0) -> DataFrame:
    """Calls keep their marker and move to another sample of the same population, all of a sample together."""
    a = sample.withColumn("r", F.row_number().over(Window.partitionBy("pop").orderBy("sample"))).select("pop", "r", "sample")
    b = sample.withColumn("r", F.row_number().over(Window.partitionBy("pop").orderBy(F.xxhash64("sample", F.lit(seed)), "sample"))).select("pop", "r", F.col("sample").alias("to"))
    return genotype.join(a.join(b, ["pop", "r"]).select("sample", "to"), "sample").select("snp", F.col("to").alias("sample"), "g")


def to_diploid(genotype: DataFrame) -> DataFrame:
    """Pairs of haploid samples NAME:A and NAME:B (calls 0 or 2) become one diploid sample NAME; both must be called."""
    stem, side = F.regexp_extract("sample", "^(.*):[AB]$", 1), F.regexp_extract("sample", ":([AB])$", 1)
    pairs = genotype.withColumns({"stem": stem, "side": side}).where("side <> ''")
    has = lambda side: F.bool_or(F.col("side") == side)
    # One aggregate with buffers of numbers: distinct sides would be grouped three times over, by strings.
    both = pairs.groupBy("snp", "stem").agg((F.sum("g") / 2).cast("bigint").alias("g"), (has("A") & has("B")).alias("both"))
    return both.where("both").select("snp", F.col("stem").alias("sample"), "g")


def to_haploid(genotype: DataFrame, seed: int = 0) -> DataFrame:
    """Each sample becomes NAME:A and NAME:B with one allele each; a heterozygote's alleles fall by a coin."""
    first = F.when(F.col("g") == 1, (coin(seed) < 0.5).cast("bigint")).otherwise(F.col("g") / 2).cast("bigint")
    sides = F.array(F.struct(F.lit(":A").alias("s"), (first * 2).alias("g")), F.struct(F.lit(":B").alias("s"), ((F.col("g") - first) * 2).alias("g")))
    return genotype.withColumn("x", F.explode(sides)).select("snp", F.concat(F.col("sample").cast("string"), F.col("x.s")).alias("sample"), F.col("x.g").alias("g"))


def strand_flip(marker: DataFrame, listed: DataFrame) -> DataFrame:
    """Markers with the alleles of listed ones complemented; calls stay."""
    other = lambda c: F.when(F.col("turn"), F.translate(c, "ACGT", "TGCA")).otherwise(F.col(c)).alias(c)
    rows = marker.join(listed.select("snp").distinct().withColumn("turn", F.lit(True)), "snp", "left").withColumn("turn", F.coalesce("turn", F.lit(False)))
    return rows.select(*[other(c) if c in ("ref", "alt") else F.col(c) for c in marker.columns])


def apart(marker: DataFrame, least: float = 1e-8, step: float = 1e-9) -> DataFrame:
    """Markers of a chromosome whose genpos (Morgans) do not differ by ``least`` get positions ``step`` apart, in
    the order of physpos and snp."""
    along = Window.partitionBy("chrom").orderBy("genpos", "physpos", "snp")
    new = F.coalesce(F.col("genpos") - F.lag("genpos").over(along) >= least, F.lit(True)).cast("bigint")
    rows = marker.withColumn("_new", new).withColumn("_run", F.sum("_new").over(along))
    run = Window.partitionBy("chrom", "_run").orderBy("genpos", "physpos", "snp")
    fixed = F.first("genpos").over(run) + step * (F.row_number().over(run) - 1)
    return rows.withColumn("genpos", fixed).select(*marker.columns)


def without_distances(marker: DataFrame) -> DataFrame:
    return marker.withColumn("genpos", F.lit(0).cast(marker.schema["genpos"].dataType))


def wipe_chromosome(genotype: DataFrame, marker: DataFrame, chrom: int) -> DataFrame:
    """The calls without those of a chromosome."""
    return genotype.join(marker.where(F.col("chrom") == chrom).select("snp"), "snp", "left_anti")
