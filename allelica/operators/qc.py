"""Quality-control reports: missingness, duplicates, chromosome dropout, allele-count tables, spectra."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelica.operators import tiles
from allelica.operators.counts import allele_counts


def missing_by_marker(genotype: DataFrame, sample: DataFrame, marker: DataFrame) -> DataFrame:
    n = sample.count()
    per = genotype.join(sample.select("sample"), "sample", "left_semi").groupBy("snp").agg(F.count("*").alias("present"))
    out = marker.select("snp").join(per, "snp", "left").select("snp", F.coalesce("present", F.lit(0)).alias("present"))
    return out.withColumn("missing", F.lit(n).cast("bigint") - F.col("present"))


def missing_by_sample(genotype: DataFrame, sample: DataFrame, marker: DataFrame) -> DataFrame:
    n = marker.count()
    per = genotype.join(marker.select("snp"), "snp", "left_semi").groupBy("sample").agg(F.count("*").alias("present"), F.sum((F.col("g") == 1).cast("bigint")).alias("hets"))
    out = sample.select("sample", "pop").join(per, "sample", "left")
    out = out.select("sample", "pop", F.coalesce("present", F.lit(0)).alias("present"), F.coalesce("hets", F.lit(0)).alias("hets"))
    return out.withColumn("missing", F.lit(n).cast("bigint") - F.col("present"))


def missing_by_population(genotype: DataFrame, sample: DataFrame) -> DataFrame:
    """pop, markers (with data), calls, het_rate."""
    rows = genotype.join(sample.select("sample", "pop"), "sample")
    per = rows.groupBy("pop", "snp").agg(F.count("*").alias("n"), F.sum((F.col("g") == 1).cast("bigint")).alias("h"))
    return per.groupBy("pop").agg(F.count("*").alias("markers"), F.sum("n").alias("calls"), (F.sum("h") / F.sum("n")).alias("het_rate"))


def treemix_table(genotype: DataFrame, sample: DataFrame) -> DataFrame:
    """snp, pop, ref, other at markers with data in every population."""
    pops = sample.select("pop").distinct().count()
    counts = allele_counts(genotype, sample)
    whole = counts.groupBy("snp").agg(F.count("*").alias("k")).where(F.col("k") == pops).select("snp")
    return counts.join(whole, "snp", "left_semi").select("snp", "pop", F.col("n1").alias("ref"), F.col("n0").alias("other"))


#: Pairs of calls that a task counts at once, and calls of a marker whose pairs are counted one by one at most.
PAIRS, FEW = 4_000_000, 2048


def similar_samples(genotype: DataFrame, shared: int = 200, agree: float = 0.9, tile: int = 512, chunk: int = 16_384) -> DataFrame:
    """a, b, shared, same: all pairs of samples that agree at ``agree`` of at least ``shared`` common markers.

    Markers that few samples have calls at (a sixteenth of them, ``FEW`` at most) give the pairs of their own calls, added
    up over neighbouring markers in the task. Other markers are dealt to chunks, samples to tiles, and every two
    tiles meet in a task for each chunk, which counts all their pairs by matrix products. Counts of both are added
    up. Every two calls of a marker are counted, so missing calls lose no pair.
    """
    names, _ = tiles.numbered_samples(genotype.select("sample").distinct().withColumn("grp", F.lit(0)))
    sizes = genotype.groupBy("snp").agg(F.count("*").alias("n"))
    samples = names.count()
    few = F.col("n") <= min(FEW, samples // 16)
    full, thin = sizes.agg(F.count_if(~few), F.count_if(few)).first()
    rows = genotype.join(names, "sample").select("snp", "k", "g")
    found = []
    if thin:
        own = rows if not full else rows.join(sizes.where(few).select("snp"), "snp", "left_semi")
        found.append(_pairs_of_calls(own))
    if full:
        own = rows if not thin else rows.join(sizes.where(~few).select("snp"), "snp", "left_semi")
        found.append(_pairs_of_tiles(own, max(1, -(-2 * samples // tile)), max(1, -(-2 * full // chunk))))
    if not found:
        return genotype.select(F.col("sample").alias("a"), F.col("sample").alias("b"), F.lit(0).cast("bigint").alias("shared"), F.lit(0).cast("bigint").alias("same")).limit(0)
    whole = reduce(DataFrame.unionByName, found).where("x < y").groupBy("x", "y").agg(F.sum("shared").alias("shared"), F.sum("same").alias("same"))
    alike = whole.where((F.col("shared") >= shared) & (F.col("same") >= agree * F.col("shared")))
    for own, name in (("x", "a"), ("y", "b")):
        alike = alike.join(names.select(F.col("k").alias(own), F.col("sample").alias(name)), own)
    return alike.select("a", "b", "shared", "same")


_COUNTS = "x int, y int, shared bigint, same bigint"


def _pairs_of_calls(rows: DataFrame) -> DataFrame:
    """x, y, shared, same of all pairs of calls of a marker, from ``rows`` (snp, k, g); markers in the order of their ids,
    ``PAIRS`` pairs at once."""

    def run(batches):
        for whole in batches:
            lengths = np.diff(whole.column("w").offsets.to_numpy())
            work, at = np.cumsum(lengths * (lengths - 1) // 2), 0
            while at < len(whole):
                end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + PAIRS, side="right")))
                n, code = lengths[at:end], whole.column("w").slice(at, end - at).flatten().to_numpy().astype(np.int64)
                code = np.sort(np.repeat(np.arange(len(n)), n) << 32 | code) & 0xFFFFFFFF
                # Each call meets those behind it at its marker.
                behind = np.repeat(np.cumsum(n), n) - np.arange(len(code)) - 1
                one = np.repeat(np.arange(len(code)), behind)
                two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(behind) - behind, behind)
                a, b = code[one], code[two]
                key = np.sort((a >> 2) << 32 | (b >> 2) << 1 | (a & 3 == b & 3))
                at = end
                if not len(key):
                    continue
                start = np.flatnonzero(np.diff(key >> 1, prepend=-1))
                counts = np.diff(start, append=len(key))
                x, y = key[start] >> 32, (key[start] & 0xFFFFFFFF) >> 1
                out = pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(counts), pa.array(np.add.reduceat(key & 1, start))], ["x", "y", "shared", "same"])
                for k in range(0, len(out), 1 << 18):
                    yield out.slice(k, 1 << 18)

    held = rows.groupBy("snp").agg(F.collect_list(tiles.coded(F.col("k"), F.col("g"))).alias("w"))
    return held.repartitionByRange("snp").sortWithinPartitions("snp").select("w").mapInArrow(run, _COUNTS)


def _pairs_of_tiles(rows: DataFrame, count: int, chunks: int) -> DataFrame:
    """The same by matrix products of tiles of samples, by chunks of markers."""
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    place = rows.select("snp").distinct().withColumn("chunk", spread("snp", chunks))
    place = place.withColumn("at", F.row_number().over(Window.partitionBy("chunk").orderBy("snp")) - 1)
    cells = rows.join(place, "snp").select("k", "chunk", tiles.coded(F.col("at"), F.col("g")).alias("code"))
    sent = tiles.packed(cells, "k", "chunk").withColumn("t", spread("k", count))
    # Each tile meets every other once: the pair is named by the lesser tile first.
    sent = sent.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("o")).withColumns({"t1": F.least("t", "o"), "t2": F.greatest("t", "o")}).drop("o")

    def pairs(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("k")
        first = table["t"].to_numpy() == table["t1"].to_numpy()
        both = table["t1"][0].as_py() == table["t2"][0].as_py()
        _, (planes,) = tiles.common_planes(table["w"].combine_chunks())
        held, same = 0, 0
        for x in tiles.three(*planes):
            x = tiles.spread(x).astype(np.float32)
            held, same = held + x, same + x @ x.T
        i, j = np.nonzero(np.triu(np.ones((len(first),) * 2, dtype=bool), 1) & (both | (first[:, None] != first[None, :])))
        common = (held @ held.T)[i, j].astype(np.int64)
        i, j, common = i[common > 0], j[common > 0], common[common > 0]
        k = table["k"].to_numpy()
        return pa.table([pa.array(k[i]), pa.array(k[j]), pa.array(common), pa.array(same[i, j].astype(np.int64))], ["x", "y", "shared", "same"])

    return sent.groupBy("chunk", "t1", "t2").applyInArrow(pairs, _COUNTS)


def duplicate_samples(genotype: DataFrame, keys: int = 15, probes: int = 20, shared: int = 200, agree: float = 0.9) -> DataFrame:
    """a, b, shared, same as ``similar_samples``, but only of pairs that have equal calls at all ``keys`` markers of
    a probe: a fast path for true duplicates among well-called samples, not a search for all similar pairs.

    The probes are the ``keys`` most heterozygous markers, the next ``keys`` and so on. Only candidates are
    compared over all markers.
    """
    hets = genotype.groupBy("snp").agg(F.sum((F.col("g") == 1).cast("bigint")).alias("h"), F.count("*").alias("n"))
    top = hets.orderBy(F.col("h").desc(), F.col("n").desc(), "snp").limit(keys * probes)
    ranked = top.select("snp", F.floor((F.row_number().over(Window.orderBy(F.col("h").desc(), F.col("n").desc(), "snp")) - 1) / keys).alias("part"))
    code = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("snp", "g"))), lambda x: F.concat_ws(":", x["snp"].cast("string"), x["g"].cast("string"))))
    keyed = genotype.join(F.broadcast(ranked), "snp").groupBy("sample", "part").agg(code.alias("code"), F.count("*").alias("k")).where(F.col("k") == keys)
    a, b = keyed.alias("a"), keyed.alias("b")
    pairs = a.join(b, ["part", "code"]).where("a.sample < b.sample").select(F.col("a.sample").alias("a"), F.col("b.sample").alias("b")).distinct()
    return compare_samples(genotype, pairs).where((F.col("shared") >= shared) & (F.col("same") >= agree * F.col("shared")))


def compare_samples(genotype: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, shared, same over the markers at which both have calls."""
    x = genotype.select("snp", F.col("sample").alias("a"), F.col("g").alias("ga"))
    y = genotype.select("snp", F.col("sample").alias("b"), F.col("g").alias("gb"))
    rows = pairs.join(x, "a").join(y, ["b", "snp"])
    return rows.groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum((F.col("ga") == F.col("gb")).cast("bigint")).alias("same"))


def chromosome_dropout(genotype: DataFrame, marker: DataFrame, sample: DataFrame, share: int = 5) -> DataFrame:
    """sample, chrom, present, expected where a chromosome has no more than a fifth of the calls expected
    from the sample's call rate elsewhere."""
    size = marker.groupBy("chrom").agg(F.count("*").alias("size"))
    total = marker.count()
    rows = genotype.join(marker.select("snp", "chrom"), "snp")
    per = rows.groupBy("sample", "chrom").agg(F.count("*").alias("present"))
    whole = per.groupBy("sample").agg(F.sum("present").alias("calls"), F.map_from_entries(F.collect_list(F.struct("chrom", "present"))).alias("by_chrom"))
    sizes = F.broadcast(size.agg(F.collect_list(F.struct("chrom", "size")).alias("sizes")))
    grid = whole.join(sizes).select("sample", "calls", "by_chrom", F.explode("sizes").alias("s"))
    present = F.coalesce(F.try_element_at("by_chrom", F.col("s.chrom")), F.lit(0))
    expected = F.col("calls") * F.col("s.size") / F.lit(total)
    out = grid.select("sample", F.col("s.chrom").alias("chrom"), present.alias("present"), expected.alias("expected"))
    return out.where(F.col("present") * share <= F.col("expected"))


def choose(n: Column, k: int) -> Column:
    """Binomial coefficient of a small fixed k."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return out


def joint_spectrum(counts: DataFrame, sizes: dict, by: list[str] | None = None) -> DataFrame:
    """One column per population with its number of reference alleles, and ``expected`` markers.

    Every population is sampled down to its size without replacement; a marker spreads over all
    configurations by their hypergeometric chances. Markers with fewer alleles than a size are dropped. ``by``
    are further columns of the counts to sum by.
    """
    pops = list(sizes)
    wide = counts.groupBy("snp", *(by or [])).agg(*[F.max(F.when(F.col("pop") == p, F.col(c))).cast("double").alias(f"{c}_{k}") for k, p in enumerate(pops) for c in ("n0", "n1")])
    for k, p in enumerate(pops):
        wide = wide.where(F.col(f"n0_{k}") + F.col(f"n1_{k}") >= sizes[p])
    for k, p in enumerate(pops):
        s = sizes[p]
        chance = lambda i, s=s, k=k: choose(F.col(f"n1_{k}"), i) * choose(F.col(f"n0_{k}"), s - i) / choose(F.col(f"n0_{k}") + F.col(f"n1_{k}"), s)
        wide = wide.withColumn(f"x{k}", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), chance(i).alias("w")) for i in range(s + 1)])))
    weight = F.lit(1.0)
    for k in range(len(pops)):
        weight = weight * F.col(f"x{k}.w")
    return wide.groupBy(*[F.col(f"x{k}.i").alias(f"k{k}") for k in range(len(pops))], *(by or [])).agg(F.sum(weight).alias("expected"))


def spectrum_blocks(counts: DataFrame, sizes: dict, blocks: DataFrame) -> DataFrame:
    """k0, k1, ..., block, top, bot, n: the joint spectrum's expected markers by configuration and block, with all
    the block's markers as bot, for a jackknife of each configuration's share."""
    marked = counts.join(blocks.select("snp", "block"), "snp")
    own = [F.col(f"k{k}") for k in range(len(sizes))]
    parts = joint_spectrum(marked, sizes, ["block"]).withColumnRenamed("expected", "top")
    whole = parts.groupBy("block").agg(F.sum("top").alias("bot"))
    grid = parts.select(*own).distinct().join(F.broadcast(whole), F.lit(True))
    out = grid.join(parts, [*[f"k{k}" for k in range(len(sizes))], "block"], "left")
    return out.select(*own, "block", F.coalesce("top", F.lit(0.0)).alias("top"), "bot", F.col("bot").alias("n"))


def duplicate_ids(marker: DataFrame, name: Column) -> DataFrame:
    """name, copies of the marker names that stand more than once."""
    return marker.groupBy(name.alias("name")).agg(F.count("*").alias("copies")).where("copies > 1")


def duplicate_positions(marker: DataFrame) -> DataFrame:
    """before, snp, chrom, physpos of neighbouring markers at one position, in the order of position and snp."""
    along = Window.partitionBy("chrom").orderBy("physpos", "snp")
    rows = marker.select(F.lag("snp").over(along).alias("before"), "snp", "chrom", "physpos", F.lag("physpos").over(along).alias("last"))
    return rows.where("last = physpos").drop("last")


def missing_populations(genotype: DataFrame, sample: DataFrame, marker: DataFrame) -> DataFrame:
    """snp, pops (with data), missing_pops of every marker."""
    n = sample.select("pop").distinct().count()
    rows = genotype.join(sample.select("sample", "pop"), "sample").groupBy("snp").agg(F.count_distinct("pop").alias("pops"))
    out = marker.select("snp").join(rows, "snp", "left").select("snp", F.coalesce("pops", F.lit(0)).alias("pops"))
    return out.withColumn("missing_pops", F.lit(n).cast("bigint") - F.col("pops"))


def fingerprints(genotype: DataFrame) -> DataFrame:
    """sample, calls, print: a sum over the calls of numbers made of marker and call, so equal samples have equal
    prints in any order and any partitioning. Marker ids are whole numbers."""
    number = (F.col("snp") * 2_654_435_761 + (F.col("g") + 1) * 40_503 * (F.col("snp") % 65_521 + 1)) % 4_294_967_291
    return genotype.groupBy("sample").agg(F.count("*").alias("calls"), F.sum(number).alias("print"))


def trend_test(genotype: DataFrame, sample: DataFrame, marker: DataFrame, x: int = 23) -> DataFrame:
    """snp, n, chi2: n times the squared correlation of calls and case status (column ``affected``, 0 or 1). Calls
    of males (sex M) on chromosome ``x`` count half. 0 where an allele or a status is absent or nothing varies."""
    rows = genotype.join(sample.select("sample", "sex", F.col("affected").cast("double").alias("y")), "sample").join(marker.select("snp", "chrom"), "snp")
    rows = rows.withColumn("x", F.when((F.col("sex") == "M") & (F.col("chrom") == x), F.floor(F.col("g") / 2)).otherwise(F.col("g")).cast("double"))
    s = rows.groupBy("snp").agg(
        F.count("*").alias("n"), F.sum("g").alias("ref"), *[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "yy", "xy")],
        F.sum("x").alias("sx"), F.sum("y").alias("sy"),
    )
    n = F.col("n")
    cov, vx, vy = (n * F.col(f"{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") for a, b in ("xy", "xx", "yy"))
    seen = (F.col("ref") > 0) & (F.col("ref") < 2 * n) & (F.col("sy") > 0) & (F.col("sy") < n) & (vx * vy > 0)
    return s.select("snp", "n", F.when(seen, n * cov * cov / (vx * vy)).otherwise(0.0).alias("chi2"))


def sex_difference(genotype: DataFrame, sample: DataFrame, marker: DataFrame, x: int = 23) -> DataFrame:
    """snp, z: contingency score of alleles by sex, positive where females have the reference allele more often.
    Males' calls on chromosome ``x`` count half."""
    rows = genotype.join(sample.select("sample", (F.col("sex") == "M").alias("male")), "sample").join(marker.select("snp", "chrom"), "snp")
    share = F.when(F.col("male") & (F.col("chrom") == x), 0.5).otherwise(1.0)
    cell = lambda male, alleles: F.sum(F.when(F.col("male") == male, share * alleles).otherwise(0.0)) + 1e-8
    c = rows.groupBy("snp").agg(*[cell(m, a).alias(f"{n}{k}") for n, m in (("m", True), ("f", False)) for k, a in ((0, 2 - F.col("g")), (1, F.col("g")))])
    total = F.col("m0") + F.col("m1") + F.col("f0") + F.col("f1")
    chi, first = F.lit(0.0), None
    for s in "mf":
        for k in (0, 1):
            want = (F.col(f"{s}0") + F.col(f"{s}1")) * (F.col(f"m{k}") + F.col(f"f{k}")) / total
            first = F.col("m0") - want if first is None else first
            chi = chi + (F.col(f"{s}{k}") - want) * (F.col(f"{s}{k}") - want) / want
    return c.select("snp", (F.sqrt(chi + 1e-12) * F.when(first < 0, -1).otherwise(1)).alias("z"))


def difference(estimates: DataFrame, first: int, second: int) -> DataFrame:
    """diff, se, chi2 of two independent estimates (qid, est, se)."""
    one, two = (estimates.where(F.col("qid") == k).select(F.col("est").alias(f"e{k}"), F.col("se").alias(f"s{k}")) for k in (first, second))
    d, v = F.col(f"e{first}") - F.col(f"e{second}"), F.col(f"s{first}") * F.col(f"s{first}") + F.col(f"s{second}") * F.col(f"s{second}")
    # Two single rows.
    return one.join(F.broadcast(two), F.lit(True)).select(d.alias("diff"), F.sqrt(v).alias("se"), (d * d / v).alias("chi2"))
