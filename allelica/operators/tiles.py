"""Packed genotypes: words of samples a marker, and pairs of marker tiles counted in one task.

A marker is a binary value of records, one for every word of 16 samples in which it has a call: the word's number and
three bit planes, ``c`` called, ``p1`` one reference allele, ``p2`` two. Samples are numbered by group and id, and a group
starts at a whole word, so counts by group are products of slices. Words without a call cost nothing, in a shuffle or in a
product: the work follows the calls, and a full marker costs five bits a sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLANES = ("c", "p1", "p2")
#: Samples of a word, and what a word with a call is stored as.
WORD, RECORD = 16, np.dtype([("w", "<i4"), *[(c, "<u2") for c in PLANES]])
#: Samples of a product at once: a batch of so many columns of 0 and 1.
SAMPLES = 8192
#: Calls that are packed at once.
CALLS = 4_000_000
#: Markers of a tile, its bytes where all calls are there, and the markers of a product.
TILE, TILE_BYTES, ROWS = 1024, 64_000_000, 128
#: Meetings of calls counted at once; one costs as much as ``DENSE`` cells and samples of a product.
MEETS, DENSE = 1_000_000, 200


def numbered_samples(sample: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(sample, k) and the words (start, end) of each group 0, 1, ... of ``sample`` (sample, grp); a row for each
    sample, a range for each group."""
    sizes = {r.grp: r["count"] for r in sample.groupBy("grp").count().collect()}
    ranges, at = [], 0
    for g in range(max(sizes, default=-1) + 1):
        width = -(-sizes.get(g, 0) // WORD)
        ranges.append((at, at + width))
        at += width
    start = F.element_at(F.array(*[F.lit(WORD * a) for a, _ in ranges] or [F.lit(0)]), F.col("grp") + 1)
    place = F.row_number().over(Window.partitionBy("grp").orderBy("sample")) - 1
    return sample.select("sample", (start + place).cast("int").alias("k")), ranges


def coded(place: Column, g: Column) -> Column:
    """A call as one number: its place and, in the last two bits, its genotype."""
    return (place * 4 + F.when(g == 1, 1).when(g == 2, 2).otherwise(0)).cast("int")


def words(calls: pa.ListArray) -> pa.Array:
    """The records of each list of coded calls, in the order of words."""
    n, code = len(calls), calls.flatten().to_numpy()
    at = np.repeat(np.arange(n), np.diff(calls.offsets.to_numpy()))
    order = np.argsort(at << 32 | code.astype(np.int64))
    at, code = at[order], code[order]
    place, g = code >> 2, code & 3
    word, bit = place // WORD, np.left_shift(1, place % WORD).astype("<u2")
    start = np.flatnonzero(np.diff(at, prepend=-1).astype(bool) | np.diff(word, prepend=-1).astype(bool))
    out = np.zeros(len(start), dtype=RECORD)
    if len(start):
        out["w"] = word[start]
        for c, own in zip(PLANES, (bit, np.where(g == 1, bit, 0), np.where(g == 2, bit, 0)), strict=True):
            out[c] = np.bitwise_or.reduceat(own.astype("<u2"), start)
    ends = np.concatenate([[0], np.cumsum(np.bincount(at[start], minlength=n))]) * RECORD.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])


def packed(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys and ``w``, the records of all calls (``code``) of a key: one shuffle of a number for each call."""
    held = rows.groupBy(*keys).agg(F.collect_list("code").alias("w"))

    def run(batches):
        for whole in batches:
            at, sizes = 0, np.cumsum(np.diff(whole.column("w").offsets.to_numpy()))
            while at < len(whole):
                before = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, before + CALLS, side="right")))
                b = whole.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], words(b.column("w"))], [*keys, "w"])
                at = end

    kinds = dict(rows.dtypes)
    return held.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "w binary"]))


def planes(genotype: DataFrame, sample: DataFrame | None = None) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(snp, w) with the records of every marker, and the groups' ranges of words.

    ``sample`` (sample, grp) names the samples to use and their groups; all are one group without it.
    """
    names, ranges = numbered_samples((genotype.select("sample").distinct().withColumn("grp", F.lit(0))) if sample is None else sample.select("sample", "grp"))
    rows = genotype.join(names, "sample").select("snp", coded(F.col("k"), F.col("g")).alias("code"))
    return packed(rows, "snp"), ranges


def records(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row and the record of every word of binary values."""
    if not len(column):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=RECORD)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(RECORD) if ends[-1] > ends[0] else np.zeros(0, RECORD)
    return np.repeat(np.arange(len(column)), np.diff(ends) // RECORD.itemsize), flat


def common_planes(*tiles: pa.Array) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """The words, in order, in which each tile has a call, and each tile's three planes over these words."""
    held = [records(t) for t in tiles]
    shared = np.unique(held[0][1]["w"])
    for _, r in held[1:]:
        shared = np.intersect1d(shared, r["w"])
    out = []
    for t, (row, r) in zip(tiles, held, strict=True):
        own = np.zeros((3, len(t), len(shared)), dtype="<u2")
        keep = np.isin(r["w"], shared)
        row, r = row[keep], r[keep]
        place = np.searchsorted(shared, r["w"])
        for k, c in enumerate(PLANES):
            own[k, row, place] = r[c]
        out.append(list(own))
    return shared, out


def spread(plane: np.ndarray) -> np.ndarray:
    """Words as columns of 0 and 1, one for each sample."""
    return np.unpackbits(np.ascontiguousarray(plane).view(np.uint8), axis=1, bitorder="little")


def products(a: list[np.ndarray], b: list[np.ndarray], start: int, end: int) -> np.ndarray:
    """Counts of samples in words start to end of planes by (genotype, genotype) of every two rows of two tiles: an array
    of shape (rows of a, rows of b, 9), cell 3 * g1 + g2. Samples that one of the tiles lacks are left out."""
    out = np.zeros((3 * len(a[0]), 3 * len(b[0])))
    step = SAMPLES // WORD
    for at in range(start, end, step):
        x, y = (np.stack([spread(p[:, at : min(end, at + step)]) for p in three(*t)]) for t in (a, b))
        both = x.any(axis=(0, 1)) & y.any(axis=(0, 1))
        x, y = (t[:, :, both].reshape(3 * t.shape[1], int(both.sum())).astype(np.float32) for t in (x, y))
        out += x @ y.T
    return out.reshape(3, len(a[0]), 3, len(b[0])).transpose(1, 3, 0, 2).reshape(len(a[0]), len(b[0]), 9).astype(np.int64)


def three(c: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> list[np.ndarray]:
    """Planes of genotypes 0, 1 and 2."""
    return [c & ~p1 & ~p2, p1, p2]


def decoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, sample and genotype of every call of binary values, in the order of rows."""
    row, r = records(column)
    at, bit = np.nonzero(spread(r["c"][:, None])) if len(r) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    g = (r["p1"][at] >> bit & 1) + 2 * (r["p2"][at] >> bit & 1)
    return row[at], r["w"][at].astype(np.int64) * WORD + bit, g.astype(np.int64)


def near_rows(gx: np.ndarray, gy: np.ndarray, most: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of y by position, and for each row of x the range of these that its partners are in; later ones only
    where both are one tile."""
    order = np.argsort(gy, kind="stable")
    place = gy[order]
    low, high = gx - most, gx + most
    if place.dtype.kind == "f":
        low, high = np.nextafter(low, -np.inf), np.nextafter(high, np.inf)
    return order, np.searchsorted(place, gx, side="right") if same else np.searchsorted(place, low, side="left"), np.searchsorted(place, high, side="right")


def _is_pair(gx: np.ndarray, gy: np.ndarray, most: int, same: bool) -> np.ndarray:
    span = gy - gx
    return (np.abs(span) < most) & ((span > 0) if same else (span != 0))


def cells_by_calls(x: pa.Array, y: pa.Array, gx: np.ndarray, gy: np.ndarray, most: int, same: bool, ranges: list[tuple[int, int]]):
    """Rows i and j of pairs with a common sample and their counts (pairs, groups, 9), by matching calls of one sample: the
    work is the calls that meet. None where a matrix product over all samples is less."""
    one = decoded(x)
    two = one if y is x else decoded(y)
    order, low, high = near_rows(gx, gy, most, same)
    rank = np.empty(len(gy), dtype=np.int64)
    rank[order] = np.arange(len(gy))
    width = len(gy) + 1
    key = two[1] * width + rank[two[0]]
    by_key = np.argsort(key)
    key = key[by_key]
    start, end = (np.searchsorted(key, one[1] * width + v[one[0]]) for v in (low, high))
    meets = end - start
    total, pairs = int(meets.sum()), int(np.maximum(high - low, 0).sum())
    if total > MEETS and total * DENSE > 9 * pairs * WORD * len(np.unique(one[1] // WORD)):
        return None
    first = np.array([WORD * a for a, _ in ranges])
    out = []
    # Pieces of whole rows of x, so that a pair is in one of them.
    upto = np.concatenate([[0], np.cumsum(np.bincount(one[0], weights=meets, minlength=len(gx)).astype(np.int64))])
    ends = np.searchsorted(one[0], np.arange(len(gx) + 1))
    at = 0
    while at < len(gx):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + MEETS, side="right")) - 1)
        some = slice(ends[at], ends[stop])
        n = meets[some]
        own = np.repeat(np.arange(some.start, some.stop), n)
        other = by_key[np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[some], n)]
        i, j = one[0][own], two[0][other]
        keep = _is_pair(gx[i], gy[j], most, same)
        i, j, own, other = i[keep], j[keep], own[keep], other[keep]
        pair, inverse = np.unique(i * len(gy) + j, return_inverse=True)
        group = np.searchsorted(first, one[1][own], side="right") - 1
        cell = (inverse * len(ranges) + group) * 9 + 3 * one[2][own] + two[2][other]
        out.append((pair, np.bincount(cell, minlength=9 * len(ranges) * len(pair)).reshape(len(pair), len(ranges), 9)))
        at = stop
    pair = np.concatenate([np.zeros(0, np.int64), *[p for p, _ in out]])
    return pair // max(len(gy), 1), pair % max(len(gy), 1), np.concatenate([np.zeros((0, len(ranges), 9), np.int64), *[f for _, f in out]])


def cells_by_products(x: pa.Array, y: pa.Array, gx: np.ndarray, gy: np.ndarray, most: int, same: bool, ranges: list[tuple[int, int]]):
    """The same by matrix products of ``ROWS`` markers by as many, those too far apart left out."""
    by_x, by_y = np.argsort(gx, kind="stable"), np.argsort(gy, kind="stable")
    out = []
    for a in range(0, len(by_x), ROWS):
        u = by_x[a : a + ROWS]
        for b in range(a if same else 0, len(by_y), ROWS):
            v = by_y[b : b + ROWS]
            i, j = np.nonzero(_is_pair(gx[u][:, None], gy[v][None, :], most, same))
            if not len(i):
                continue
            shared, (px, py) = common_planes(x.take(pa.array(u)), y.take(pa.array(v)))
            found = np.stack([products(px, py, *np.searchsorted(shared, r))[i, j] for r in ranges], axis=1)
            keep = found.sum(axis=(1, 2)) > 0
            out.append((u[i[keep]], v[j[keep]], found[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(ranges), 9), np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def pair_cells(genotype: DataFrame, marker: DataFrame, most: int, sample: DataFrame | None = None, tile: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """snp1, snp2, chrom, distance, the markers' columns ``carry`` (as name1 and name2) and an array ``cells{k}`` of nine
    counts for each group of ``sample``, for markers of a chromosome with 0 < distance < ``most`` in genpos and a sample
    with both calls. What pairs need of their markers comes with these, so that no pair has to be joined to them.

    Markers are dealt to buckets of about ``tile`` markers, at least as wide as the band, those of a crowded bucket to
    several tiles by hash. A marker's words go to every pair of tiles that it may have partners in: its bucket's, and
    where it is within the band of a neighbour, that neighbour's too. A task holds two tiles and counts their pairs by
    matching calls, or by matrix products where the tiles are full, so words are shuffled by marker and never by pair.
    """
    held, ranges = planes(genotype, sample)
    if tile is None:  # so many that full tiles, too, are no larger than TILE_BYTES
        tile = max(ROWS, min(TILE, TILE_BYTES // (RECORD.itemsize * max([1, *[end for _, end in ranges]]))))
    kind, far = dict(genotype.dtypes)["snp"], dict(marker.dtypes)["genpos"]
    mean = marker.groupBy("chrom", F.floor(F.col("genpos") / most)).count().agg(F.avg("count")).first()[0]
    bands = max(1, min(1_000_000, int(tile / (mean or tile))))
    wide = most * bands
    place = marker.select("snp", "chrom", "genpos", *carry, F.floor(F.col("genpos") / wide).cast("bigint").alias("bucket"))
    # A row for each bucket of the genome.
    parts = place.groupBy("chrom", "bucket").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    at = lambda d, name: parts.select("chrom", (F.col("bucket") - d).alias("bucket"), F.col("parts").alias(name))
    rows = place.join(parts, ["chrom", "bucket"]).join(at(1, "after"), ["chrom", "bucket"], "left").join(at(-1, "before"), ["chrom", "bucket"], "left")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("snp"), F.col("parts")).cast("int"))
    b, own, zero = F.col("bucket"), F.col("own"), F.lit(0)
    along, edge = F.col("genpos") / wide - b, 1 / bands + 1e-6
    every = lambda high, near: F.when(F.col(high).isNotNull() & near, F.sequence(zero, F.col(high) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda bucket, p, step, q, side: F.struct(bucket.alias("b"), p.alias("p"), F.lit(step).alias("step"), q.alias("q"), F.lit(side).alias("side"))
    meets = F.concat(
        F.transform(F.sequence(own, F.col("parts") - 1), lambda q: pair(b, own, 0, q, 0)),
        F.transform(F.when(own > 0, F.sequence(zero, own - 1)).otherwise(F.array().cast("array<int>")), lambda p: pair(b, p, 0, own, 1)),
        F.transform(every("after", along >= 1 - edge), lambda q: pair(b, own, 1, q, 0)),
        F.transform(every("before", along <= edge), lambda p: pair(b - 1, p, 1, own, 1)),
    )
    sent = rows.select("snp", "chrom", "genpos", *carry, F.explode(meets).alias("t")).join(held, "snp").select("snp", "chrom", "genpos", *carry, "t.*", "w")
    with_pair = [(f"{c}{k}", dict(marker.dtypes)[c]) for c in carry for k in (1, 2)]
    fields = [("snp1", kind), ("snp2", kind), ("chrom", dict(marker.dtypes)["chrom"]), ("distance", far), *with_pair, *[(f"cells{k}", "array<bigint>") for k in range(len(ranges))]]

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        same = table["step"][0].as_py() == 0 and table["p"][0].as_py() == table["q"][0].as_py()
        side = table["side"].to_numpy()
        tiles = [table, table] if same else [table.filter(pa.array(side == s)) for s in (0, 1)]
        gx, gy = (t["genpos"].to_numpy() for t in tiles)
        x = tiles[0]["w"].combine_chunks()
        args = x, x if same else tiles[1]["w"].combine_chunks(), gx, gy, most, same, ranges
        i, j, found = cells_by_calls(*args) or cells_by_products(*args)
        span = gy[j] - gx[i]
        # Two tiles of one bucket have pairs in both orders.
        back = span < 0
        found = np.where(back[:, None, None], found.reshape(-1, len(ranges), 3, 3).transpose(0, 1, 3, 2).reshape(-1, len(ranges), 9), found)
        swap = pa.array(back)

        def ends(name: str) -> list[pa.Array]:
            one, two = (t[name].combine_chunks().take(pa.array(k)) for t, k in zip(tiles, (i, j), strict=True))
            return [pa.compute.if_else(swap, two, one), pa.compute.if_else(swap, one, two)]

        columns = [*ends("snp"), pa.array([table["chrom"][0].as_py()] * len(i), table["chrom"].type), pa.array(np.abs(span), table["genpos"].type), *[e for c in carry for e in ends(c)]]
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, 9 * len(i) + 1, 9, dtype=np.int32)), pa.array(np.ascontiguousarray(found[:, k]).ravel())) for k in range(len(ranges))]
        return pa.table([*columns, *lists], [f for f, _ in fields])

    return sent.groupBy("chrom", "b", "p", "step", "q").applyInArrow(count, ", ".join(f"{a} {t}" for a, t in fields))
