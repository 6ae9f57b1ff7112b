"""Mixing sources to target weights by hash-threshold histograms.

Every row has a fixed hash: 36 bits of its id and text, then 36 bits of a key of its own, which tells equal
rows apart. Words are summed by source and by the first 12 bits; running sums find the bucket in which a
source's budget ends. Only that boundary bucket is summed again by the next 12 bits, and so on to the last.
A row is taken when its hash lies below its source's threshold, so nothing is sorted. Reruns agree: the own
key only decides how many of some equal rows are taken.

A target of up to twice the source's size is met by whole passes over the source and one pass over the
documents below the threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelica.llm.common import ROW, discard, keyed, own_names, scratch, words_of, written

WEIGHTS = (5, 2, 1)
LEVELS = 6
MAX_BROADCAST_SOURCES = 20_000
WIDTH = 3  # hexadecimal digits of a level: 4096 buckets
DIGITS = "_mix_digits"


def digits_of(key: Column, text: Column, row: Column) -> Column:
    """The hash of a row in hexadecimal digits; half of them come from the id and the text."""
    half = WIDTH * LEVELS // 2
    named = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.concat(F.substring(F.md5(named.cast("binary")), 1, half), F.substring(F.md5(row.cast("string").cast("binary")), 1, half))


def passes(digits: Column, whole: Column, cut: Column, most: Column) -> Column:
    return F.least(whole + (digits < cut).cast("int"), most)


def sizes(docs: DataFrame, row: Column) -> DataFrame:
    """doc_id, source, size and the hash's digits. A null text has size 0; a null id counts as ''."""
    return docs.select(
        "doc_id",
        "source",
        F.size(words_of(F.col("text"))).cast("bigint").alias("size"),
        digits_of(F.col("doc_id"), F.col("text"), row).alias("digits"),
    )


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: a target stops at ``most`` times the source's size, and what is over
    is shared again by weight until no target is above its stop.

    Ordered by stop/weight, the sources that stop come first; the first source whose share of the rest is
    below its stop fixes the level for all that follow. The windows run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = reduce(
        lambda c, k: c.when((F.col("pos") % len(weights)) == k, F.lit(float(weights[k]))),
        range(1, len(weights)),
        F.when((F.col("pos") % len(weights)) == 0, F.lit(float(weights[0]))),
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("pos", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    per = per.withColumn("stop", F.col("source_size") * F.lit(float(most)))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), "pos")
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.sum("source_size").over(every) * F.lit(float(total))
    per = per.withColumn("level", (wanted - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.col("level"))
    per = per.withColumn("level", F.first(fits, ignorenulls=True).over(by_stop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return per.select(
        "source", "source_size", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("stop")), F.col("stop")).alias("target")
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, whole (passes over all of it), cut (rows with smaller digits get one pass more).

    Each level is one aggregate over the rows in the boundary buckets of the level before; its result, a row
    for each source, is written.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    open_ = written(targets.select(
        "source", whole.cast("int").alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("budget"),
        F.lit("").alias("prefix"), F.lit(0).cast("bigint").alias("words"),
    ))
    for level in range(1, LEVELS + 1):
        n = WIDTH * level
        s, o = sized.alias("s"), open_.alias("o")
        inside = s.join(o, _same(F.col("s.source"), F.col("o.source")) & (F.substring("s.digits", 1, n - WIDTH) == F.col("o.prefix")))
        sums = inside.groupBy(F.col("s.source").alias("source"), "o.budget", F.substring("s.digits", 1, n).alias("bucket")).agg(F.sum("s.size").alias("sum"))
        sums = sums.withColumn("upto", F.sum("sum").over(Window.partitionBy("source").orderBy("bucket")))
        # The boundary bucket is the first whose running sum passes the budget. Where the sum never passes it
        # (an empty source, or a budget that takes all), the cut is the end.
        edge = sums.where(F.col("upto") > F.col("budget")).groupBy("source").agg(
            F.min_by(F.struct("bucket", (F.col("budget") - (F.col("upto") - F.col("sum"))).alias("left"), "sum"), "bucket").alias("at")
        )
        keep = o.join(edge.alias("f"), _same(F.col("o.source"), F.col("f.source")), "left")
        open_ = written(keep.select(
            "o.source", "o.whole", F.coalesce("f.at.left", F.lit(0.0)).alias("budget"),
            F.coalesce("f.at.bucket", F.lit("~")).alias("prefix"), F.coalesce("f.at.sum", F.lit(0)).alias("words"),
        ))
    # The last bucket is taken when that comes nearer to the budget than leaving it.
    over = (F.col("prefix") != "~") & (F.col("budget") * 2 > F.col("words"))
    return open_.select("source", "whole", F.when(over, F.concat("prefix", F.lit("~"))).otherwise(F.col("prefix")).alias("cut"))


def cut_table(sized: DataFrame, weights: tuple = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, whole, cut, most: one row per source.

    It is broadcast while there are few sources; otherwise joins shuffle and skew is split at run time.
    """
    targets = written(source_targets(sized, weights, total, most))
    cuts = written(thresholds(sized, targets))
    t, c = targets.alias("t"), cuts.alias("c")
    plan = t.join(c, _same(F.col("t.source"), F.col("c.source"))).select(
        "t.source", "t.source_size", "t.target", "c.whole", "c.cut", F.lit(int(most)).alias("most")
    )
    few = targets.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    return F.broadcast(plan) if few else plan


def mix(docs: DataFrame, weights: tuple = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes, source: one row for each row of ``docs``.

    Null ids, null sources (a source of their own, last) and null texts (size 0) are rows like others, and so
    are repeated ids; of repeated rows as many are taken as the budget asks for. An empty table gives an empty
    result; an all-empty source has target 0; other columns are not read.
    """
    sized = written(sizes(docs.select("doc_id", "source", "text"), F.monotonically_increasing_id()))
    s, p = sized.alias("s"), cut_table(sized, weights, total, most).alias("p")
    n = passes(F.col("s.digits"), F.col("p.whole"), F.col("p.cut"), F.col("p.most"))
    return s.join(p, _same(F.col("s.source"), F.col("p.source"))).select(
        "s.doc_id", "s.size", "p.source_size", "p.target",
        (F.col("s.size") * n).cast("bigint").alias("taken"), n.cast("int").alias("passes"), "s.source",
    )


@own_names(ROW, DIGITS)
def repeat(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns as before.

    The passes follow from a row's source and hash alone, so no row is joined to another table but the one
    of sources. Nulls, empty texts, repeated rows and empty tables are treated as in ``mix``; further columns
    are passed on.
    """
    rows = keyed(docs)
    with scratch() as passed:
        sized = written(sizes(rows, F.col(ROW)))
    p = cut_table(sized, **parameters).alias("p")
    discard(docs.sparkSession, passed)  # the table of cuts is a row for each source and reads no document
    d = rows.withColumn(DIGITS, digits_of(F.col("doc_id"), F.col("text"), F.col(ROW))).alias("d")
    n = passes(F.col(f"d.{DIGITS}"), F.col("p.whole"), F.col("p.cut"), F.col("p.most"))
    rows = d.join(p, _same(F.col("d.source"), F.col("p.source"))).where(n > 0)
    return rows.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), n)).alias(DIGITS)).drop(DIGITS)
