"""Programs run from parameter files: which relations to read, which filters, which statistic, which result lines.

A parameter file names the genotype, marker and sample files; formats are found from the files. Each program is
a plan over the operators and returns a DataFrame; ``lines`` turns it into result lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelica.operators import blocks, counts, filters, fstats, jackknife, linkage, transforms
from allelica.plans import basis, graph, numeric
from allelica.sources import formats, packed
from allelica.sources import parameters as par

UNITS = 1e7  # positions are kept in 1e-7 Morgan


@dataclass
class Data:
    genotype: DataFrame
    sample: DataFrame
    marker: DataFrame


def load(spark: SparkSession, p: dict[str, str]) -> Data:
    """The dataset that the parameters name: genotypename, snpname, indivname, or ``instem`` for all three."""
    name = lambda key, end: p.get(key) or f"{p['instem']}.{end}"
    marks, people, calls = name("snpname", "snp"), name("indivname", "ind"), name("genotypename", "geno")
    ends = lambda path, *tails: path.endswith(tails)
    marker = (formats.read_map if ends(marks, ".map", ".bim", ".pedsnp") else formats.read_snp)(spark, marks)
    sample = (formats.read_fam if ends(people, ".fam", ".pedind", ".ped") else formats.read_ind)(spark, people)
    return Data(genotype(spark, calls, marker, sample), sample.where("not coalesce(ignored, false)"), marker)


def genotype(spark: SparkSession, path: str, marker: DataFrame, sample: DataFrame) -> DataFrame:
    """The calls of a file of any format, by its first line, or of a folder by its manifest."""
    if packed.is_folder(path):
        return (formats.read_eigenstrat if packed.layout(path).kind == packed.TEXT else formats.read_packed)(spark, path, marker, sample)
    first = spark.read.text(path).first()
    head = first.value if first else ""
    if head.startswith(("GENO", "TGENO")):
        return formats.read_packed(spark, path, marker, sample)
    if head.startswith("l\x1b"):
        return formats.read_bed(spark, path, marker, sample)
    fields = head.split()
    if len(fields) == 3:
        return formats.read_ancestrymap(spark, path).join(sample.where("not coalesce(ignored, false)").select("sample"), "sample", "left_semi")
    return formats.read_ped(spark, path, marker) if len(fields) > 6 else formats.read_eigenstrat(spark, path, marker, sample)


def chosen_markers(spark: SparkSession, p: dict[str, str], marker: DataFrame) -> DataFrame:
    """Markers by chromosome, position and the list of bad ones; genpos in whole 1e-7 Morgan."""
    whole = lambda key: int(p[key]) if key in p else None
    last = int(par.number(p, "numchrom", 22))
    x = par.flag(p, "xdata") or not par.flag(p, "noxdata", True)
    out = filters.chromosomes(marker.withColumn("chrom", F.col("chrom").cast("bigint")), whole("chrom"), whole("nochrom"), last, x)
    out = filters.positions(out, whole("lopos"), whole("hipos"))
    if "badsnpname" in p:
        out = filters.without_listed(out, formats._lines(spark, p["badsnpname"]).select(F.col("f")[0].alias("snp")))
    return out.withColumn("genpos", F.round(F.col("genpos") * UNITS).cast("bigint"))


def frequencies(spark: SparkSession, p: dict[str, str], pops: list[str], d: Data | None = None) -> DataFrame:
    """One row a marker with its block and the moments of the populations that a query names."""
    d = d or load(spark, p)
    marker = chosen_markers(spark, p, d.marker)
    sample = filters.in_populations(d.sample, pops)
    if most := int(par.number(p, "popsizelimit", 0)):
        sample = filters.capped_samples(sample, most, int(par.number(p, "seed", 0)))
    if par.flag(p, "inbreed"):
        stats = counts.inbred_moments(counts.class_counts(d.genotype, sample))
    else:
        stats = counts.moments(counts.allele_counts(d.genotype, sample))
    if "blockname" in p:
        own = blocks.from_table(marker, formats.read_values(spark, p["blockname"]).select("snp", F.col("value").cast("bigint").alias("block")))
    else:
        own = blocks.assign_blocks(marker, round(par.number(p, "blgsize", 0.05) * UNITS))
    return counts.by_marker(stats.join(own.select("snp", "block"), "snp"))


def tuples(spark: SparkSession, path: str, width: int) -> list[tuple[str, ...]]:
    """Lines of ``width`` populations; colons between them are marks for the reader."""
    rows = formats._lines(spark, path).orderBy("ord").collect()
    found = [tuple(w for w in r.f if w.strip(":"))[:width] for r in rows]
    if any(len(q) < width for q in found):
        raise ValueError(f"a line of {path} has less than {width} populations")
    return found


def _named(spark: SparkSession, out: DataFrame, queries) -> DataFrame:
    """The results with the populations of their lines in front, in the order of the lines."""
    names = fstats.populations_of(spark, queries)
    width = len(names.columns) - 1
    return out.join(names.withColumnsRenamed({f"q{i}": f"pop{i + 1}" for i in range(width)}), "qid").orderBy("qid").select(*[f"pop{i + 1}" for i in range(width)], *[c for c in out.columns if c != "qid"])


def d_statistic(spark: SparkSession, p: dict[str, str]) -> DataFrame:
    """Quadruples of ``popfilename``, or all three pairings of every four of ``poplistname``, which are never listed
    unless ``locount`` or ``hicount`` choose some of them."""
    queries = tuples(spark, p["popfilename"], 4) if "popfilename" in p else fstats.three_pairings(formats.read_list(spark, p["poplistname"]))
    if "locount" in p or "hicount" in p:
        low, high = int(par.number(p, "locount", 1)), int(par.number(p, "hicount", len(queries)))
        queries = queries[max(0, low - 1) : high]
    pops = queries.pops if isinstance(queries, fstats.ThreePairings) else sorted({x for q in queries for x in q})
    rows = fstats.dstat(frequencies(spark, p, pops), queries, par.flag(p, "f4mode"))
    _enough(rows, par.flag(p, "fewblocksok"))
    return _named(spark, rows, queries)


def _enough(rows: DataFrame, few: bool) -> None:
    if not few and not rows.where("blocks < 5").isEmpty():
        raise ValueError("fewer than 5 blocks; fewblocksok allows that")


def f3(spark: SparkSession, p: dict[str, str]) -> DataFrame:
    queries = tuples(spark, p["popfilename"], 3)
    return _named(spark, fstats.f3(frequencies(spark, p, sorted({x for q in queries for x in q})), queries, par.flag(p, "outgroupmode")), queries)


def f4_ratio(spark: SparkSession, p: dict[str, str]) -> DataFrame:
    """Lines of eight populations; ``fancyf4`` (on) makes pairs without a difference count as 0. With ``diffmode`` a line of
    the first half goes with its counterpart of the second, and the result is the sum of both ratios less 1."""
    queries, flat = tuples(spark, p["popfilename"], 8), par.flag(p, "fancyf4", True)
    rows = frequencies(spark, p, sorted({x for q in queries for x in q}))
    if not par.flag(p, "diffmode"):
        return _named(spark, fstats.f4_ratio(rows, queries, flat), queries)
    half = len(queries) // 2
    pairs = [(*a, *b) for a, b in zip(queries[:half], queries[half : 2 * half], strict=True)]
    return _named(spark, fstats.f4_ratio_difference(rows, pairs, flat), pairs)


def mixture_bounds(spark: SparkSession, p: dict[str, str]) -> DataFrame:
    """Lines of two sources, the mixed population and ``outpop``, or four populations each."""
    width = 3 if "outpop" in p else 4
    queries = [(*q, p["outpop"])[:4] if width == 3 else q for q in tuples(spark, p["popfilename"], width)]
    return _named(spark, fstats.bounds(frequencies(spark, p, sorted({x for q in queries for x in q})), queries), queries)


def pair_matrix(spark: SparkSession, p: dict[str, str]) -> DataFrame:
    """a, b, f2, fst with errors and nsnp for every two populations of ``poplistname``."""
    pops = formats.read_list(spark, p["poplistname"])
    return fstats.pair_matrix(frequencies(spark, p, pops), pops).orderBy("a", "b")


def heterozygosity(spark: SparkSession, p: dict[str, str]) -> DataFrame:
    """a, b, het, se, blocks for every two populations of ``poplistname`` and within each."""
    pops = formats.read_list(spark, p["poplistname"])
    return fstats.heterozygosity_errors(frequencies(spark, p, pops), pops).orderBy("a", "b")


def f4_difference(spark: SparkSession, p: dict[str, str]) -> DataFrame:
    queries = tuples(spark, p["popfilename"], 8)
    overlap = par.flag(p, "overlap", not par.flag(p, "allsnps"))
    rows = frequencies(spark, p, sorted({x for q in queries for x in q}))
    return _named(spark, fstats.f4_difference(rows, queries, par.number(p, "firstf4mult", 1.0), overlap, par.flag(p, "fancyf4")), queries)


def _matrix(spark: SparkSession, p: dict[str, str]):
    left, right = (formats.read_list(spark, p[k]) for k in ("popleft", "popright"))
    if len(set(left) & set(right)) or len(left) < 2 or len(right) < 2:
        raise ValueError("left and right need two populations each and none in both")
    sums = fstats.f4_vector_blocks(frequencies(spark, p, [*left, *right]), left, right)
    x, cov, deleted, weights = numeric.f4_matrix(sums, len(left) - 1, len(right) - 1)
    return left, right, x, numeric.shrink(cov, jackknife.effective_blocks(weights)) if par.flag(p, "oasmode", True) else cov, deleted, weights


def rank_test(spark: SparkSession, p: dict[str, str]) -> DataFrame:
    """f4rank, dof, chisq, tail of each rank, and the difference to the rank before: dofdiff, chisqdiff, taildiff."""
    _, _, x, cov, _, _ = _matrix(spark, p)
    tests = [numeric.rank_test(x, cov, r) for r in range(min(int(par.number(p, "maxrank", 99)), min(x.shape)) + 1)]
    rows, last = [], None
    for t in tests:
        step = (last.dof - t.dof, last.chi_square - t.chi_square) if last else (0, 0.0)
        rows.append((t.rank, t.dof, t.chi_square, t.tail, step[0], step[1], numeric.chi_square_tail(step[1], step[0])))
        last = t
    return spark.createDataFrame(rows, "f4rank int, dof int, chisq double, tail double, dofdiff int, chisqdiff double, taildiff double")


def admixture(spark: SparkSession, p: dict[str, str]) -> DataFrame:
    """pattern, dof, chisq, tail, feasible, nested (tail against the full model) and source, weight, se: all
    patterns of sources fixed at zero; errors of the full model."""
    left, _, x, cov, deleted, weights = _matrix(spark, p)
    whole, _, _ = numeric.admixture_weights(x, cov)
    se, _ = numeric.weight_errors(deleted, whole, cov, weights)
    models = numeric.sub_models(x, cov)
    rows = []
    for m in models:
        nested = numeric.chi_square_tail(m["chisq"] - models[0]["chisq"], m["dof"] - models[0]["dof"])
        for k, source in enumerate(left[1:]):
            rows.append((m["pattern"], m["dof"], m["chisq"], m["tail"], m["feasible"], nested, source, float(m["weights"][k]), float(se[k]) if m is models[0] else None))
    return spark.createDataFrame(rows, "pattern string, dof int, chisq double, tail double, feasible boolean, nested double, source string, weight double, se double")


def fstats_file(spark: SparkSession, p: dict[str, str]) -> DataFrame:
    """The basis of ``poplistname``, its first population the base, as the lines of a basis file."""
    pops = formats.read_list(spark, p["poplistname"])
    text = basis.fit(frequencies(spark, p, pops), pops).dump()
    return spark.createDataFrame([(k, v) for k, v in enumerate(text.splitlines())], "ord int, value string").orderBy("ord").select("value")


def graph_fit(spark: SparkSession, p: dict[str, str]) -> DataFrame:
    """kind, name, value: score, dof, tail, drifts of edges, shares of mixed nodes and Z of outliers of ``graphname``
    fitted to the basis of ``fstatsname``, or to one computed from the genotypes with ``outpop`` as base."""
    text = lambda key: spark.read.text(p[key], wholetext=True).first().value
    g = graph.read(text("graphname"))
    if "fstatsname" in p:
        found = basis.Basis.load(text("fstatsname"))
    else:
        base = p.get("outpop", next(iter(g.labels)))
        pops = [base, *[x for x in g.labels if x != base]]
        found = basis.fit(frequencies(spark, p, pops), pops)
    got = graph.fit(g, found, limit=par.number(p, "zthresh", 3.0))
    rows = [("score", "", got.score), ("dof", "", float(got.dof)), ("tail", "", got.tail)]
    rows += [("edge", k, v) for k, v in got.drifts.items()] + [("share", k, v) for k, v in got.shares.items()]
    return spark.createDataFrame(rows + [("outlier", f"{a},{b}", z) for (a, b), z in got.outliers], "kind string, name string, value double")


def convert(spark: SparkSession, p: dict[str, str]) -> Data:
    """The dataset after the converter's steps, in their fixed order; ``write`` stores it.

    Steps: markers by chromosome, position and list; samples by population list or own list; male X
    heterozygotes; heterozygotes; alleles by strand; duplicate positions; flips; polarity; filling, shuffling and
    forcing of missing calls; wiping of a chromosome; linkage, Hardy-Weinberg, regions, missingness; thinning.
    """
    d = load(spark, p)
    listed = lambda key, name="snp": formats._lines(spark, p[key]).select(F.col("f")[0].alias(name))
    seed = int(par.number(p, "seed", 0))
    marker, sample, g = chosen_markers(spark, p, d.marker), d.sample, d.genotype
    if "poplistname" in p:
        sample = filters.in_populations(sample, formats.read_list(spark, p["poplistname"]))
    if "samplename" in p:
        sample = filters.listed_samples(d.sample, listed("samplename", "sample"))
    g = g.join(marker.select("snp"), "snp", "left_semi").join(sample.select("sample"), "sample", "left_semi")
    if not par.flag(p, "malexhet", True):
        g = filters.without_male_x_hets(g, sample, marker, int(par.number(p, "numchrom", 22)) + 1)
    for key, how in (("transformhets", "two"), ("randomhetfix", "random")):
        if par.flag(p, key):
            g = transforms.hets_to(g, how, seed)
    if "flipstrandname" in p:
        marker = transforms.strand_flip(marker, listed("flipstrandname"))
    if par.flag(p, "zerodistance"):
        marker = transforms.without_distances(marker)
    if par.flag(p, "deletedup", True):
        marker = filters.distinct_positions(marker, F.col("snp"))
    if "flipsnpname" in p:
        g = transforms.flip(g, listed("flipsnpname"))
    if "polarize" in p:
        g = transforms.polarize(g, p["polarize"])
    if par.flag(p, "fillmissing"):
        g = transforms.fill_missing(g, sample, marker, seed)
    if par.flag(p, "shuffle"):
        g = transforms.shuffle_samples(g, sample, seed)
    if share := par.number(p, "forcemissing", 0):
        g = transforms.force_missing(g, share, seed)
    if "wipechrom" in p:
        g = transforms.wipe_chromosome(g, marker, int(p["wipechrom"]))
    if limit := par.number(p, "killr2", 0) and par.number(p, "r2thresh", 0.8):
        far = round(par.number(p, "r2genlim", 0.01) * UNITS)
        linked = linkage.r_squared(linkage.pair_tables(g, marker, far)).where(F.col("r2") >= limit)
        named = marker.select("snp", F.xxhash64("snp").alias("id"), "chrom", F.col("genpos").alias("at"))
        scores = g.groupBy("snp").agg(F.count("*").alias("score")).join(named, "snp").select(F.col("id").alias("snp"), "chrom", F.col("at").alias("ord"), "score")
        pairs = linked.select(F.xxhash64("snp1").alias("snp1"), F.xxhash64("snp2").alias("snp2"), "chrom")
        stay = filters.linked_prune(scores, pairs).withColumnRenamed("snp", "id")
        marker = marker.join(named.join(stay, "id", "left_semi").select("snp"), "snp", "left_semi")
    if limit := par.number(p, "hwfilter", 0):
        marker = marker.join(filters.hardy_weinberg(g, sample, limit).select("snp"), "snp", "left_semi")
    if "xregionname" in p:
        f = F.col("f")
        regions = formats._lines(spark, p["xregionname"]).select(f[0].cast("bigint").alias("chrom"), f[1].cast("bigint").alias("low"), f[2].cast("bigint").alias("high"))
        marker = filters.outside_regions(marker, regions)
    if "maxmissfrac" in p:
        marker = marker.join(filters.max_missing(g, sample, par.number(p, "maxmissfrac", 1)).select("snp"), "snp", "left_semi")
    if gap := par.number(p, "decimate", 0):
        marker = filters.thinned(marker, round(gap * UNITS))
    marker = marker.withColumn("genpos", F.col("genpos") / F.lit(UNITS))
    return Data(g.join(marker.select("snp"), "snp", "left_semi"), sample, renumbered(marker))


def renumbered(marker: DataFrame) -> DataFrame:
    """The rows in their order, numbered anew from 0: a marker's place is the number of rows before it, counted by
    chromosome first, so no task holds more than a chromosome."""
    from pyspark.sql import Window

    own = F.row_number().over(Window.partitionBy("chrom").orderBy("genpos", "physpos", "snp")) - 1
    sizes = marker.groupBy("chrom").agg(F.count("*").alias("n"))
    before = sizes.select("chrom", F.coalesce(F.sum("n").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return marker.withColumn("k", own).join(F.broadcast(before), "chrom").withColumn("ord", (F.col("k") + F.col("before")).cast("bigint")).select(*marker.columns)


#: Packed formats by the names that parameter files use.
PACKED = {"PACKEDANCESTRYMAP": "GENO", "GENO": "GENO", "TGENO": "TGENO", "TRANSPOSE_PACKED": "TGENO", "PACKEDPED": "BED", "BED": "BED"}


def write(d: Data, p: dict[str, str]) -> None:
    """The dataset in ``outputformat``: ANCESTRYMAP or PED as folders of text parts, EIGENSTRAT and packed ones as folders
    with a manifest."""
    kind = p.get("outputformat", "EIGENSTRAT").upper()
    places = d.sample.select("sample").distinct().count()
    sample = d.sample
    if places:
        from pyspark.sql import Window

        sample = sample.withColumn("ord", (F.row_number().over(Window.orderBy("ord")) - 1).cast("bigint"))  # a row for each sample
    if kind == "ANCESTRYMAP":
        formats.write_ancestrymap(d.genotype, p["genotypeoutname"])
    elif kind == "PED":
        formats.write_ped(d.genotype, d.marker, sample, p["genotypeoutname"])
    elif kind == "EIGENSTRAT":
        formats.write_eigenstrat(d.genotype, d.marker, sample, p["genotypeoutname"])
    elif kind in PACKED:
        formats.write_packed(d.genotype, d.marker, sample, p["genotypeoutname"], PACKED[kind])
    else:
        raise ValueError(f"{kind} is no format")
    if "snpoutname" in p:
        formats.snp_lines(d.marker).write.text(p["snpoutname"])
    if "indivoutname" in p:
        formats.ind_lines(sample).write.text(p["indivoutname"])


PROGRAMS = {
    "dstat": d_statistic, "f3": f3, "f4ratio": f4_ratio, "f4diff": f4_difference, "rank": rank_test, "admixture": admixture, "fstats": fstats_file, "graph": graph_fit,
    "bounds": mixture_bounds, "pairs": pair_matrix, "heterozygosity": heterozygosity,
}


def run(spark: SparkSession, program: str, path: str) -> DataFrame:
    """A program's result from a parameter file."""
    return PROGRAMS[program](spark, par.read(spark, path))


def lines(results: DataFrame) -> DataFrame:
    return formats.result_lines(results, results.columns)
