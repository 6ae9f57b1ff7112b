"""Genome blocks: greedy segmentation along a chromosome, or a block table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches of block size, or groups of them, that one task joins.
SPAN = 16


def greedy_starts(position: np.ndarray, size: int) -> np.ndarray:
    """Block number within a chromosome of sorted positions: a block starts at the first marker that lies
    ``size`` or more beyond its predecessor's first marker."""
    out = np.zeros(len(position), dtype=np.int64)
    at, block = 0, 0
    while at < len(position):
        after = int(np.searchsorted(position, position[at] + size, side="left"))
        after = max(after, at + 1)
        out[at:after] = block
        at, block = after, block + 1
    return out


def _children(pdf: pd.DataFrame, width: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, entry, reach, blocks) of each stretch of ``width`` buckets, in order."""
    own = pdf.sort_values("entry", kind="stable")
    return [(k, g["entry"].to_numpy(), g["reach"].to_numpy(), g["n"].to_numpy()) for k, g in own.groupby(own["bucket"] // width, sort=True)]


def _joined(width: int, span: int):
    """The map of a stretch from those of its children: where a run of blocks that enters it at an entry leaves it."""

    def up(key, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("entry", kind="stable")
        # A run comes in less than a block size behind the first bucket, or at the first position beyond a gap.
        near = int((own["bucket"] <= key[1] * width * span + 1).sum())
        out = own.iloc[: near + 1].copy()
        reach, n = out["reach"].to_numpy().copy(), out["n"].to_numpy().copy()
        for _, entry, on, blocks in _children(pdf, width):
            at = np.searchsorted(entry, reach)
            inside = at < len(entry)
            reach[inside], n[inside] = on[at[inside]], n[inside] + blocks[at[inside]]
        return out.assign(reach=reach, n=n)

    return up


def _followed(key, pdf: pd.DataFrame, width: int, at, before: int) -> pd.DataFrame:
    """The entry of each child that the run of blocks from ``at`` on enters, and the blocks before it."""
    out = []
    for child, entry, on, blocks in _children(pdf, width):
        k = int(np.searchsorted(entry, at))
        if k < len(entry):
            out.append((key[0], child, entry[k], before, before + int(blocks[k])))
            at, before = on[k], before + int(blocks[k])
    return pd.DataFrame(out, columns=["chrom", "stretch", "entry", "before", "after"])


def _from_first(width: int):
    return lambda key, pdf: _followed(key, pdf, width, pdf["entry"].min(), 0)


def _from_start(width: int):
    def down(key, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(start):
            return _followed(key, pdf.head(0), width, 0, 0)
        return _followed(key, pdf, width, start["entry"].iloc[0], int(start["before"].iloc[0]))

    return down


def assign_blocks(marker: DataFrame, size: int = 500_000, span: int = SPAN) -> DataFrame:
    """The markers with ``block``, numbered from 1 over chromosomes and positions; those without a position go.

    ``size`` is in the units of genpos (500,000 of 1e-7 Morgan are 0.05 Morgan). Chromosomes are cut into
    buckets of that size. From each distinct position the next block starts in a later bucket, so a stretch of
    buckets maps the positions at which a run of blocks may enter it, those of its first two buckets, to where the
    run leaves it. Maps of ``span`` stretches are joined to one until ``span`` of them cover a chromosome, with fewer
    rows at each level; then the one run that begins at the first position is followed back down. A task holds
    the positions of ``span`` buckets, never a chromosome, and a bucket holds at most one block's start.
    """
    kind = dict(marker.dtypes)["genpos"]
    low, high = marker.agg(F.min("genpos"), F.max("genpos")).first()
    most = 0 if low is None else int((high - low) // size)
    bucket = F.floor((F.col("genpos") - F.lit(low)) / F.lit(size)).cast("bigint")
    placed = marker.where(F.col("genpos").isNotNull()).withColumn("bucket", bucket)
    reach = (F.col("genpos") + F.lit(size)).cast(kind).alias("reach")
    maps = [placed.select("chrom", "bucket", F.col("genpos").alias("entry"), reach, F.lit(1).cast("bigint").alias("n")).distinct()]
    width = 1
    while width * span <= most:
        maps.append(maps[-1].groupBy("chrom", _stretch(width * span)).applyInPandas(_joined(width, span), maps[0].schema))
        width *= span
    kinds = f"chrom {dict(marker.dtypes)['chrom']}, stretch bigint, entry {kind}, before bigint, after bigint"
    start = maps.pop().groupBy("chrom").applyInPandas(_from_first(width), kinds)
    # ``span`` rows for each chromosome: the blocks of the chromosomes before are those of earlier rows.
    rows = Window.orderBy("chrom", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("after") - F.col("before")).over(rows), F.lit(0))
    start = start.withColumn("before", before.cast("bigint"))
    for level in reversed(maps):
        groups = level.groupBy("chrom", _stretch(width))
        width //= span
        start = groups.cogroup(start.groupBy("chrom", "stretch")).applyInPandas(_from_start(width), kinds)
    # A block ends in the bucket after its start's at the latest: positions before a bucket's own start are of the
    # start in the bucket before.
    own = "struct(stretch as bucket, entry as entry, before + 1 as own, null as earlier)"
    later = f"struct(stretch + 1 as bucket, cast(null as {kind}) as entry, null as own, before + 1 as earlier)"
    edges = start.select("chrom", F.inline(F.expr(f"array({own}, {later})")))
    edges = edges.groupBy("chrom", "bucket").agg(*(F.max(c).alias(c) for c in ("entry", "own", "earlier")))
    block = F.when(F.col("genpos") >= F.col("entry"), F.col("own")).otherwise(F.col("earlier")).alias("block")
    return placed.join(edges, ["chrom", "bucket"]).select(*marker.columns, block)


def _stretch(width: int) -> Column:
    return F.floor(F.col("bucket") / F.lit(width)).cast("bigint").alias("stretch")


def from_table(marker: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks as listed (snp, block); markers that are unlisted or below 1 are dropped."""
    return marker.join(blocks.where("block > 0"), "snp")
