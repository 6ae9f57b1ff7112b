"""The f-statistic family: sums over markers by block for tuples of populations, and a jackknife.

``markers`` is the result of counts.by_marker: snp, block, m. Its moments are laid out once a marker as arrays in the
order of the populations. Tuples are rows of small numbers, sent to the tasks or made there from their own number
(``ThreePairings``); tasks compute batches of markers by batches of tuples and add them up by block before the shuffle.
No tuple is a literal of the plan and no row is made for a marker and tuple.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelica.operators import jackknife


class ThreePairings(Sequence):
    """For every four of the populations the three ways of pairing them, by number: nothing is listed."""

    def __init__(self, pops: Sequence):
        self.pops = list(pops)
        n = len(self.pops)
        # below[k][i]: choices of k populations whose first one stands before place i.
        self.below = [np.cumsum([0, *[comb(n - 1 - i, k - 1) for i in range(n)]]) if k else None for k in range(5)]

    def __len__(self) -> int:
        return 3 * comb(len(self.pops), 4)

    def take(self, low: int, high: int) -> np.ndarray:
        """Places of the four populations of tuples ``low`` to ``high``, a row for each."""
        number = np.arange(low, high, dtype=np.int64)
        left, turn = number // 3, number % 3
        four, start = np.zeros((len(number), 4), dtype=np.int64), np.zeros(len(number), dtype=np.int64)
        for k in range(4):
            below = self.below[4 - k]
            left = left + below[start]  # choices whose first population stands before ``start`` are not there
            four[:, k] = np.searchsorted(below, left, side="right") - 1
            left -= below[four[:, k]]
            start = four[:, k] + 1
        order = np.array([(0, 1, 2, 3), (0, 2, 1, 3), (0, 3, 1, 2)])[turn]
        return np.take_along_axis(four, order, axis=1)

    def __getitem__(self, k):
        if isinstance(k, slice):
            return [self[i] for i in range(*k.indices(len(self)))]
        if not -len(self) <= k < len(self):
            raise IndexError(k)
        at = k % len(self)
        return tuple(self.pops[i] for i in self.take(at, at + 1)[0])


class AllStatistics(ThreePairings):
    """Every f2 as (a, b, a, b), f3 as (a, b, a, c) and f4 of some populations once, by number."""

    def _sizes(self) -> tuple[int, int, int]:
        n = len(self.pops)
        return comb(n, 2), n * comb(n - 1, 2), 3 * comb(n, 4)

    def __len__(self) -> int:
        return sum(self._sizes())

    @staticmethod
    def two(number: np.ndarray, n: int) -> np.ndarray:
        """The ``number``-th choices of two of ``n``."""
        below = np.cumsum([0, *range(n - 1, -1, -1)])
        first = np.searchsorted(below, number, side="right") - 1
        return np.stack([first, first + 1 + number - below[first]], axis=1)

    def take(self, low: int, high: int) -> np.ndarray:
        n, (f2, f3, _) = len(self.pops), self._sizes()
        number = np.arange(low, high, dtype=np.int64)
        two = self.two(number[number < f2], n)[:, [0, 1, 0, 1]]
        own = number[(number >= f2) & (number < f2 + f3)] - f2
        a, rest = np.divmod(own, max(1, comb(n - 1, 2)))
        pair = self.two(rest, n - 1)
        pair += pair >= a[:, None]  # the populations but a
        three = np.stack([a, pair[:, 0], a, pair[:, 1]], axis=1)
        start, end = max(low, f2 + f3) - f2 - f3, high - f2 - f3
        return np.concatenate([two, three, super().take(start, end) if end > start else np.zeros((0, 4), dtype=np.int64)])


class Listed:
    """Tuples of a list, as places of their populations."""

    def __init__(self, queries: Sequence[Sequence]):
        self.pops = list(dict.fromkeys(p for q in queries for p in q))
        place = {p: k for k, p in enumerate(self.pops)}
        self.places = np.array([[place[p] for p in q] for q in queries], dtype=np.int64)

    def __len__(self) -> int:
        return len(self.places)

    def take(self, low: int, high: int) -> np.ndarray:
        return self.places[low:high]


class Batch:
    """Moments of a batch of markers (rows) at the places of a batch of tuples (columns)."""

    def __init__(self, fields: dict[str, np.ndarray], q: np.ndarray):
        self.fields, self.q = fields, q

    def __call__(self, name: str, k: int) -> np.ndarray:
        return self.fields[name][:, self.q[:, k]]

    def same(self, i: int, j: int) -> np.ndarray:
        return self.q[:, i] == self.q[:, j]

    def f4(self, a: int, b: int, c: int, d: int) -> np.ndarray:
        return (self("p", a) - self("p", b)) * (self("p", c) - self("p", d))

    def corrected(self, a: int, b: int, c: int, d: int) -> np.ndarray:
        """f4 with the correction of populations that stand squared: + c where a = c or b = d, - c where a = d or b = c."""
        top = self.f4(a, b, c, d)
        for i, j, sign in ((a, c, 1), (b, d, 1), (a, d, -1), (b, c, -1)):
            top = top + np.where(self.same(i, j), sign * self("c", i), 0.0)
        return top

    def flat(self, a: int, b: int, c: int, d: int) -> np.ndarray:
        """As ``corrected``; without a population in both pairs it is 0 where the frequencies of one pair agree, whether
        or not those of the other are known."""
        level = (np.abs(self("p", a) - self("p", b)) < LEVEL) | (np.abs(self("p", c) - self("p", d)) < LEVEL)
        shared = self.same(a, c) | self.same(a, d) | self.same(b, c) | self.same(b, d)
        return np.where(shared, self.corrected(a, b, c, d), np.where(level, 0.0, self.f4(a, b, c, d)))


#: Frequencies nearer than this agree.
LEVEL = 1e-5


def tuple_sums(
    markers: DataFrame, queries: Sequence[Sequence], names: Sequence[str], terms: Callable[[Batch], Sequence[np.ndarray]], fields: str = "p",
    cells: int = 2_000_000, complete: bool = False,
) -> DataFrame:
    """qid, block, the sums of the ``names`` and n, of ``terms``: an array (markers, tuples) for each name, with nan where
    unknown. A marker counts for a tuple where all are known; with ``complete`` only where they are for all tuples.
    ``fields`` are the moments that the terms use, a letter each."""
    tuples = queries if isinstance(queries, ThreePairings) else Listed(queries)
    sent = markers.sparkSession.sparkContext.broadcast(tuples)  # a list's own size, or that of the populations
    lay = lambda f: F.array(*[F.coalesce(F.try_element_at("m", F.lit(p))[f].cast("double"), F.lit(float("nan"))) for p in tuples.pops])
    wide = markers.select(F.col("block").cast("bigint").alias("block"), *[lay(f).alias(f) for f in fields])

    def run(batches):
        every = sent.value
        for b in batches:
            block = b.column("block").to_numpy()
            if not len(block):
                continue
            order = np.argsort(block, kind="stable")
            held = {f: b.column(f).flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1)[order] for f in fields}
            own, first = np.unique(block[order], return_index=True)
            step = max(1, cells // len(block))
            parts = range(0, len(every), step)
            values = lambda at: terms(Batch(held, every.take(at, min(len(every), at + step))))  # noqa: E731, B023
            if complete:
                whole = np.logical_and.reduce([~np.isnan(sum(values(at))).any(axis=1) for at in parts])[:, None]
            for at in parts:
                found = values(at)
                known = ~np.isnan(sum(found))
                if complete:
                    known = known & whole
                sums = [np.add.reduceat(np.where(known, x, 0.0), first, axis=0) for x in found]
                n = np.add.reduceat(known.astype(np.int64), first, axis=0)
                i, j = np.nonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array((j + at).astype(np.int32)), pa.array(own[i]), *[pa.array(x[i, j]) for x in sums], pa.array(n[i, j])], ["qid", "block", *names, "n"])

    found = wide.mapInArrow(run, f"qid int, block bigint, {', '.join(f'{c} double' for c in names)}, n bigint")
    return found.groupBy("qid", "block").agg(*[F.sum(c).alias(c) for c in (*names, "n")])


def populations_of(spark: SparkSession, queries: Sequence[Sequence]) -> DataFrame:
    """qid, q0, q1, ...: the populations of the tuples, written out by the tasks."""
    tuples = queries if isinstance(queries, ThreePairings) else Listed(queries)
    width, names = tuples.take(0, 1).shape[1], pa.array(tuples.pops)
    kind, sent = "bigint" if pa.types.is_integer(names.type) else "string", spark.sparkContext.broadcast(tuples)

    def run(batches):
        for b in batches:
            k = b.column("id").to_numpy()
            if len(k):
                q = np.concatenate([sent.value.take(int(x), int(x) + 1) for x in k])
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), *[names.take(pa.array(q[:, i])) for i in range(width)]], ["qid", *[f"q{i}" for i in range(width)]])

    return spark.range(len(tuples)).mapInArrow(run, f"qid int, {', '.join(f'q{i} {kind}' for i in range(width))}")


def _one(x: np.ndarray) -> np.ndarray:
    """1 where a value is known."""
    return np.where(np.isnan(x), np.nan, 1.0)


def _tuples(queries: Sequence[Sequence]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("qid"), F.array(*map(F.lit, q)).alias("q")) for k, q in enumerate(queries)])


def spread(markers: DataFrame, queries: Sequence[Sequence], width: int) -> DataFrame:
    """A row per marker and tuple: qid, block, snp, and for place k the columns p{k}, h{k}, c{k}, n{k}."""
    rows = markers.select("snp", "block", "m", F.explode(_tuples(queries)).alias("t"))
    at = lambda k, field: F.try_element_at("m", F.col("t.q")[k])[field]
    columns = [at(k, f).alias(f"{f}{k}") for k in range(width) for f in ("p", "h", "c", "n")]
    return rows.select("snp", "block", F.col("t.qid").alias("qid"), F.col("t.q").alias("q"), *columns)


def f4(a: str, b: str, c: str, d: str) -> Column:
    return (F.col(a) - F.col(b)) * (F.col(c) - F.col(d))


def _finish(sums: DataFrame, queries: Sequence[Sequence], name: str, extra: list[Column] | None = None, totals: list[Column] | None = None) -> DataFrame:
    jack = jackknife.ratio(sums, ["qid"])
    total = sums.groupBy("qid").agg(F.sum("n").cast("bigint").alias("nsnp"), *(totals or []))
    out = jack.join(total, "qid")
    return out.select(
        "qid", F.col("est").alias(name), "se", jackknife.z_score(F.col("jack"), F.col("se")).alias("z"), "nsnp", "blocks", *(extra or [])
    )


def dstat(markers: DataFrame, queries: Sequence[Sequence], f4mode: bool = False) -> DataFrame:
    """qid, d, se, z, nsnp, blocks, baba, abba over markers where all four populations have data.

    With p_i the frequencies, BABA - ABBA is (p0-p1)(p2-p3) and their sum the product of the pairs'
    mismatches; in f4 mode the denominator is the count.
    """
    if not isinstance(queries, ThreePairings) and any(len(set(q)) < 4 for q in queries):
        raise ValueError("a D statistic needs four different populations")
    sums = d_blocks(markers, queries, f4mode)
    return _finish(sums, queries, "d", [F.col("baba"), F.col("abba")], [F.sum("baba").alias("baba"), F.sum("abba").alias("abba")])


def d_blocks(markers: DataFrame, queries: Sequence[Sequence], f4mode: bool = False, cells: int = 2_000_000) -> DataFrame:
    """qid, block, top, bot, n, baba, abba of D statistics; a task computes at most ``cells`` products at once."""

    def terms(x: Batch):
        w = [x("p", k) for k in range(4)]
        ab, ba, cd, dc = (w[i] * (1 - w[j]) for i, j in ((0, 1), (1, 0), (2, 3), (3, 2)))
        return ab * cd + ba * dc, ab * dc + ba * cd

    sums = tuple_sums(markers, queries, ["baba", "abba"], terms, cells=cells)
    bot = F.col("n").cast("double") if f4mode else F.col("baba") + F.col("abba")
    return sums.select("qid", "block", (F.col("baba") - F.col("abba")).alias("top"), bot.alias("bot"), "n", "baba", "abba")


def three_pairings(pops: Sequence) -> ThreePairings:
    return ThreePairings(pops)


def f4_statistic(markers: DataFrame, queries: Sequence[Sequence]) -> DataFrame:
    return dstat(markers, queries, f4mode=True).withColumnRenamed("d", "f4").drop("baba", "abba")


def f3(markers: DataFrame, queries: Sequence[Sequence], outgroup: bool = False) -> DataFrame:
    """qid, f3, se, z, nsnp for (A, B, C): the target C last. The numerator is corrected for C's sampling, the
    denominator is twice C's half heterozygosity, or a constant with an outgroup. nsnp counts polymorphic
    markers, the weights all valid ones."""

    def terms(x: Batch):
        p0, p1, p2, h2 = x("p", 0), x("p", 1), x("p", 2), x("h", 2)
        varied = ~((p0 == p1) & (p1 == p2) & ((p0 == 0) | (p0 == 1)))
        return (p2 - p0) * (p2 - p1) + x("c", 2), 0.001 * _one(h2) if outgroup else 2 * h2, varied.astype(float)

    sums = tuple_sums(markers, queries, ["top", "bot", "poly"], terms, "phc")
    out = _finish(sums, queries, "f3", [F.col("poly")], [F.sum("poly").cast("bigint").alias("poly")])
    return out.select("qid", "f3", "se", "z", F.col("poly").alias("nsnp"), "blocks")


def f4_ratio(markers: DataFrame, queries: Sequence[Sequence], flat: bool = False) -> DataFrame:
    """qid, alpha, se, z, nsnp for eight populations: f4 of the first four over f4 of the last four. With ``flat`` terms
    are as ``Batch.flat``: populations may repeat, and a pair without a difference makes a marker count as 0."""
    terms = lambda x: [(x.flat if flat else x.f4)(*places) for places in ((0, 1, 2, 3), (4, 5, 6, 7))]
    return _finish(tuple_sums(markers, queries, ["top", "bot"], terms, "pc" if flat else "p"), queries, "alpha")


def f4_ratio_difference(markers: DataFrame, queries: Sequence[Sequence], flat: bool = False) -> DataFrame:
    """qid, excess, se, z, nsnp for sixteen populations: the ratio of the first eight plus that of the last eight less 1,
    over markers that count in both; 0 where the two are shares of one mixture."""

    def terms(x: Batch):
        return [(x.flat if flat else x.f4)(*range(k, k + 4)) for k in (0, 4, 8, 12)]

    names = ["t1", "b1", "t2", "b2"]
    sums = tuple_sums(markers, queries, names, terms, "pc" if flat else "p")
    own = jackknife.Window.partitionBy("qid")
    sums = sums.withColumns({f"s{c}": F.sum(c).over(own) for c in names})
    full = F.try_divide("st1", "sb1") + F.try_divide("st2", "sb2") - 1
    rest = lambda c: F.col(f"s{c}") - F.col(c)
    less = F.try_divide(rest("t1"), rest("b1")) + F.try_divide(rest("t2"), rest("b2")) - 1
    jack = jackknife.jackknife(sums, ["qid"], full, less)
    total = sums.groupBy("qid").agg(F.sum("n").cast("bigint").alias("nsnp"))
    return jack.join(total, "qid").select("qid", F.col("est").alias("excess"), "se", jackknife.z_score(F.col("jack"), F.col("se")).alias("z"), "nsnp", "blocks")


def f4_difference(markers: DataFrame, queries: Sequence[Sequence], factor: float = 1.0, overlap: bool = True, flat: bool = False) -> DataFrame:
    """qid, diff, se, z, nsnp: f4 of the first four times ``factor`` less f4 of the last four, both as ``Batch.flat``
    with ``flat``.

    With overlap over markers valid in both; else the difference of two means with the valid counts as
    weights, and nsnp the markers valid in either.
    """
    fields = "pc" if flat else "p"

    def both(x: Batch):
        f4 = x.flat if flat else x.f4
        return f4(0, 1, 2, 3) * factor, f4(4, 5, 6, 7)

    if overlap:

        def terms(x: Batch):
            a, b = both(x)
            return a - b, _one(a + b)

        return _finish(tuple_sums(markers, queries, ["top", "bot"], terms, fields), queries, "diff")

    def either(x: Batch):
        a, b = both(x)
        none = np.where(np.isnan(a) & np.isnan(b), np.nan, 0.0)
        known = lambda v, held: np.where(np.isnan(v), 0.0, held) + none
        return known(a, a), known(a, 1.0), known(b, b), known(b, 1.0)

    sums = tuple_sums(markers, queries, ["ta", "na", "tb", "nb"], either, fields).withColumnRenamed("n", "either")
    sums = sums.withColumn("n", F.col("na") + F.col("nb"))
    own = jackknife.Window.partitionBy("qid")
    sums = sums.withColumns({f"s{c}": F.sum(c).over(own) for c in ("ta", "na", "tb", "nb")})
    full = F.col("sta") / F.col("sna") - F.col("stb") / F.col("snb")
    less = F.try_divide(F.col("sta") - F.col("ta"), F.col("sna") - F.col("na")) - F.try_divide(F.col("stb") - F.col("tb"), F.col("snb") - F.col("nb"))
    jack = jackknife.jackknife(sums, ["qid"], full, less)
    total = sums.groupBy("qid").agg(F.sum("either").cast("bigint").alias("nsnp"))
    return jack.join(total, "qid").select("qid", F.col("est").alias("diff"), "se", jackknife.z_score(F.col("jack"), F.col("se")).alias("z"), "nsnp", "blocks")


def pattern_probability(x: Batch, pattern: str) -> np.ndarray:
    """Probability of an A/B pattern and of its complement over the places' frequencies."""
    one = other = 1.0
    for k, letter in enumerate(pattern):
        p = x("p", k)
        one, other = (one * p, other * (1 - p)) if letter == "A" else (one * (1 - p), other * p)
    return one + other


def partitioned_d(markers: DataFrame, queries: Sequence[Sequence], first: str, second: str, fmode: bool = False, scale: float = 1e6) -> DataFrame:
    """qid, score, se, z, nsnp: (P1 - P2) / (P1 + P2) of two patterns over all the places, or with ``fmode``
    their scaled difference per marker."""

    def terms(x: Batch):
        u, v = pattern_probability(x, first), pattern_probability(x, second)
        return (u - v) * (scale if fmode else 1.0), _one(u + v) if fmode else u + v

    return _finish(tuple_sums(markers, queries, ["top", "bot"], terms), queries, "score")


def bounds(markers: DataFrame, queries: Sequence[Sequence]) -> DataFrame:
    """qid, lower, upper: bounds of the mixture share for (A, B, C, outgroup).

    All statistics are over twice C's half heterozygosity. s1 and s2 are f3(outgroup; A, C) and
    f3(outgroup; B, C), taken against f2-like totals of A and B with the outgroup.
    """

    def terms(x: Batch):
        o = lambda i, j: (x("p", i) - x("p", 3)) * (x("p", j) - x("p", 3))
        c = [x("c", k) for k in range(4)]
        f3 = (x("p", 2) - x("p", 0)) * (x("p", 2) - x("p", 1)) + c[2]
        return f3, o(0, 2) + c[3], o(1, 2) + c[3], o(0, 0) + c[0] + c[3], o(1, 1) + c[1] + c[3], 2 * x("h", 2)

    names = ("f3", "s1", "s2", "a", "b")
    sums = tuple_sums(markers, queries, [*names, "bot"], terms, "phc").groupBy("qid").agg(*[(F.sum(c) / F.sum("bot")).alias(c) for c in names])
    y = -F.col("f3") - F.col("s1")
    cross = F.try_divide(y, F.col("s2") - F.col("s1"))
    lower = F.greatest(F.col("s1") / F.col("a"), F.when(F.col("s2") > F.col("s1"), cross))
    upper = F.least(1 - F.col("s2") / F.col("b"), F.when(F.col("s2") < F.col("s1"), cross))
    return sums.select("qid", lower.alias("lower"), upper.alias("upper"))


def pair_matrix(markers: DataFrame, pops: Sequence) -> DataFrame:
    """a, b, f2, fst, f2_se, nsnp for every two populations: N = (pa-pb)^2 + ca + cb, D = N + ha + hb, ratio of sums."""
    queries = [(a, b) for i, a in enumerate(pops) for b in pops[i + 1 :]]

    def terms(x: Batch):
        num = (x("p", 0) - x("p", 1)) ** 2 + x("c", 0) + x("c", 1)
        return num, np.nan_to_num(num + x("h", 0) + x("h", 1))

    sums = tuple_sums(markers, queries, ["top", "den"], terms, "phc").join(populations_of(markers.sparkSession, queries), "qid")
    keys = ["qid", "q0", "q1"]
    f2 = jackknife.ratio(sums.withColumn("bot", F.col("n").cast("double")), keys).select("qid", F.col("est").alias("f2"), F.col("se").alias("f2_se"))
    fst = jackknife.ratio(sums.withColumn("bot", F.col("den")), keys).select(*keys, F.col("est").alias("fst"), F.col("se").alias("fst_se"))
    total = sums.groupBy("qid").agg(F.sum("n").cast("bigint").alias("nsnp"))
    return fst.join(f2, "qid").join(total, "qid").select(F.col("q0").alias("a"), F.col("q1").alias("b"), "f2", "f2_se", "fst", "fst_se", "nsnp")


def _mismatches(markers: DataFrame, pops: Sequence) -> tuple[list[tuple], DataFrame]:
    """Pairs of populations, and qid, block, top, bot, n of their differing and of all pairs of alleles."""
    queries = [(a, b) for i, a in enumerate(pops) for b in pops[i:]]

    def terms(x: Batch):
        within, n0, n1 = x.same(0, 1), x("n", 0), x("n", 1)
        r0, r1 = np.floor(x("p", 0) * n0 + 0.5), np.floor(x("p", 1) * n1 + 0.5)
        return np.where(within, 2 * (n0 - r0) * r0, (n0 - r0) * r1 + r0 * (n1 - r1)), np.where(within, n0 * (n0 - 1), n0 * n1)

    return queries, tuple_sums(markers, queries, ["top", "bot"], terms, "pn")


def heterozygosity_matrix(markers: DataFrame, pops: Sequence) -> DataFrame:
    """a, b, het: within a population 2ab over n(n-1), between two the mismatch of one allele each."""
    queries, sums = _mismatches(markers, pops)
    sums = sums.groupBy("qid").agg((F.sum("top") / F.sum("bot")).alias("het"))
    return sums.join(populations_of(markers.sparkSession, queries), "qid").select(F.col("q0").alias("a"), F.col("q1").alias("b"), "het")


def heterozygosity_errors(markers: DataFrame, pops: Sequence) -> DataFrame:
    """a, b, het, se, blocks: the matrix by block jackknife. Every marker of a block adds to its weight, known or not."""
    queries, sums = _mismatches(markers, pops)
    held = markers.groupBy("block").agg(F.count("*").alias("held"))
    pairs = populations_of(markers.sparkSession, queries).select("qid", F.col("q0").alias("a"), F.col("q1").alias("b"))
    # All pairs of a block as a list, so that a block without calls of a pair still is one of its blocks.
    every = held.select("block", "held", F.explode(F.sequence(F.lit(0), F.lit(len(queries) - 1))).alias("qid"))
    none = {"top": 0.0, "bot": 0.0}
    whole = every.join(sums.select("qid", "block", *none), ["qid", "block"], "left").fillna(none)
    jack = jackknife.ratio(whole, ["qid"], weight="held").join(pairs, "qid")
    return jack.select("a", "b", F.col("jack").alias("het"), "se", "blocks")


def f4_vector_blocks(markers: DataFrame, left: Sequence, right: Sequence) -> DataFrame:
    """qid, block, top, n of f4(L0, Li; R0, Rj) for all i, j: what rank tests and admixture weights start from."""
    queries = [(left[0], a, right[0], b) for a in left[1:] for b in right[1:]]
    return tuple_sums(markers, queries, ["top", "bot"], lambda x: (x.f4(0, 1, 2, 3), _one(x.f4(0, 1, 2, 3))))


def basis_blocks(markers: DataFrame, pops: Sequence) -> DataFrame:
    """qid, block, top, bot, n of f3(base; a, b) for all pairs a <= b of the populations after the base."""
    queries = [(a, b, pops[0]) for i, a in enumerate(pops[1:]) for b in pops[1 + i :]]

    def terms(x: Batch):
        top = (x("p", 0) - x("p", 2)) * (x("p", 1) - x("p", 2)) + x("c", 2) + np.where(x.same(0, 1), x("c", 0), 0.0)
        return top, _one(top)

    return tuple_sums(markers, queries, ["top", "bot"], terms, "pc")


def _general(x: Batch) -> tuple[np.ndarray, np.ndarray]:
    """f(a, b; c, d) with the correction of populations that stand squared."""
    top = x.corrected(0, 1, 2, 3)
    return top, _one(top)


def general_blocks(markers: DataFrame, quads: Sequence[Sequence]) -> DataFrame:
    """qid, block, top, bot, n of f(a, b; c, d) for any quadruples, populations that stand squared corrected:
    + c where a = c or b = d, - c where a = d or b = c."""
    return tuple_sums(markers, quads, ["top", "bot"], _general, "pc")


def inbreeding(classes: DataFrame, blocks: DataFrame) -> DataFrame:
    """pop, inbreeding, se, nsnp, blocks: the share of heterozygosity between samples that is missing within them,
    sum(H - h) / sum(H) by block jackknife, over markers with two samples of the population or more."""
    s = F.col("x0") + F.col("x1") + F.col("x2")
    between = 2 * (F.col("x0") * F.col("x2") + (F.col("x0") + F.col("x2")) * F.col("x1") / 2 + F.col("x1") * (F.col("x1") - 1) / 4) / (s * (s - 1))
    rows = classes.where(s >= 2).join(blocks.select("snp", "block"), "snp").select("pop", "block", between.alias("bot"), (between - F.col("x1") / s).alias("top"))
    sums = rows.groupBy("pop", "block").agg(F.sum("top").alias("top"), F.sum("bot").alias("bot"), F.count("*").alias("n"))
    total = sums.groupBy("pop").agg(F.sum("n").alias("nsnp"))
    return jackknife.ratio(sums, ["pop"]).join(total, "pop").select("pop", F.col("est").alias("inbreeding"), "se", "nsnp", "blocks")


def fst_scale(matrix: DataFrame) -> DataFrame:
    """scale: FST regressed on f2 without a constant, weighted by the inverse variance of FST, from ``pair_matrix``."""
    w = 1 / ((F.col("fst_se") + 1e-10) * (F.col("fst_se") + 1e-10))
    return matrix.agg((F.sum(w * F.col("fst") * F.col("f2")) / F.sum(w * F.col("f2") * F.col("f2"))).alias("scale"))


def frequency_correlation(markers: DataFrame, queries: Sequence[Sequence]) -> DataFrame:
    """qid, rho, se, blocks: Pearson correlation of two populations' frequencies over markers with both, with a
    block jackknife from six sums."""
    terms = ("s11", "s22", "s12", "s1", "s2", "n")

    def products(x: Batch):
        a, b = x("p", 0) + 0 * x("p", 1), x("p", 1) + 0 * x("p", 0)
        return a * a, b * b, a * b, a, b

    sums = tuple_sums(markers, queries, terms[:5], products)
    own = jackknife.Window.partitionBy("qid")
    sums = sums.withColumns({f"all_{c}": F.sum(c).over(own) for c in terms})

    def rho(at) -> Column:
        n = at("n")
        cov, v1, v2 = (at(f"s{i}{j}") - at(f"s{i}") * at(f"s{j}") / n for i, j in ((1, 2), (1, 1), (2, 2)))
        return F.try_divide(cov, F.sqrt(v1 * v2))

    whole, less = rho(lambda c: F.col(f"all_{c}")), rho(lambda c: F.col(f"all_{c}") - F.col(c))
    return jackknife.jackknife(sums, ["qid"], whole, less).select("qid", F.col("jack").alias("rho"), "se", "blocks")


def variance_weighted_f4(markers: DataFrame, queries: Sequence[Sequence]) -> DataFrame:
    """qid, f4, se, blocks: block means weighted by the inverse of their variances, from the spread of the markers
    within a block; blocks of one marker or without spread are left out."""
    rows = spread(markers, queries, 4).withColumn("v", f4("p0", "p1", "p2", "p3")).where("v is not null")
    own = rows.groupBy("qid", "block").agg(F.avg("v").alias("mean"), (F.var_samp("v") / F.count("*")).alias("var")).where("var > 0")
    sums = own.select("qid", "block", (F.col("mean") / F.col("var")).alias("top"), (1 / F.col("var")).alias("bot"), (1 / F.col("var")).alias("n"))
    return jackknife.ratio(sums, ["qid"]).select("qid", F.col("jack").alias("f4"), "se", "blocks")


def subset(queries: Sequence[Sequence], low: int, high: int) -> list[tuple[int, Sequence]]:
    """Lines ``low`` to ``high`` of a list of tuples, both from 1 on and included, with their numbers."""
    return [(k, q) for k, q in enumerate(queries, 1) if low <= k <= high]


def complete_blocks(markers: DataFrame, quads: Sequence[Sequence]) -> DataFrame:
    """qid, block, top, bot, n as ``general_blocks``, over markers where all the statistics are known."""
    return tuple_sums(markers, quads, ["top", "bot"], _general, "pc", complete=True)


#: The edges on the path between each two of four populations, in the order of their six pairs. Edges lead
#: to the populations and, third, join the first two to the last two.
TREE_PATHS = ((1, 1, 0, 0, 0), (1, 0, 1, 1, 0), (1, 0, 1, 0, 1), (0, 1, 1, 1, 0), (0, 1, 1, 0, 1), (0, 0, 0, 1, 1))


def tree_lengths(markers: DataFrame, queries: Sequence[Sequence]) -> DataFrame:
    """qid, edge (0 to 4), length, se, z, blocks: the five edges of the tree ((a, b), (c, d)) by least squares from the
    six unbiased squared frequency differences, over the expected mismatch of both pairs; weighted block jackknife.

    The edges are a constant projection of the six block sums, so each is a ratio of sums like any other statistic.
    """
    project = np.linalg.pinv(np.array(TREE_PATHS, dtype=np.float64))
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]

    def terms(x: Batch):
        w = [x("p", k) for k in range(4)]
        f2 = np.stack([(w[i] - w[j]) ** 2 - x("h", i) / x("n", i) - x("h", j) / x("n", j) for i, j in pairs])
        mismatch = lambda i, j: w[i] * (1 - w[j]) + w[j] * (1 - w[i])
        return *np.tensordot(project, f2, axes=1), mismatch(0, 1) * mismatch(2, 3)

    edges = [f"e{k}" for k in range(5)]
    sums = tuple_sums(markers, queries, [*edges, "bot"], terms, "phn")
    rows = sums.select("qid", "block", "n", "bot", F.posexplode(F.array(*edges)).alias("edge", "top"))
    jack = jackknife.ratio(rows, ["qid", "edge"])
    return jack.select("qid", "edge", F.col("jack").alias("length"), "se", jackknife.z_score(F.col("jack"), F.col("se")).alias("z"), "blocks")
