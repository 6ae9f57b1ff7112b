"""Hard negatives by a vector-approximation file.

Every component is scaled to an integer and quantised to a cell of its dimension; cells of a dimension are equally
wide, between the least and the greatest value. The file has a row for each vector: its cells, a byte each, and the
exact integers. For an anchor one table lookup for each dimension gives the least score that a vector with these cells
can have; the greatest lies above it by a margin that depends on the anchor alone, as cells are equally wide. Only
vectors that may still enter are scored exactly:

* positives are the best rows of the anchor's label: rows whose upper bound reaches the least but one lower bound;
* negatives are rows of other labels in the window under each positive's score: rows whose bounds meet the window and
  reach the best that surely lie in it.

The file is dealt to tiles of a bounded number of rows. The anchors, a stated share of the rows, are sent to every tile
in turn behind its rows, so a task holds one tile and one batch of anchors; every tile returns its best few for each
anchor, and the best of these follow from a window over the anchor. No anchors, rows or scores pass through the driver,
which sees the least and greatest value of each dimension and the number of rows.

Rows with a null id, label or vector, or with a null or non-finite component take no part; nor do those with an integer
of 2^24 or more, whose scores may pass 64 bits. Shorter vectors count as padded with zeros. Repeated rows are rows of
their own; ties go to the smaller id. An empty table, or one without anchors, gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelica.llm.common import written

MOST = 1 << 24
#: Cells of a dimension (a byte holds them), rows of a tile, and products of an anchor batch with a tile at once.
CELLS, TILE, PAIRS = 128, 100_000, 4_000_000


def integers(rows: DataFrame, id: str, vector: str, label: str, anchor: Column, scale: int) -> DataFrame:
    """id, label, v, anchor of the rows that take part; v are integers."""
    x = F.col(vector)
    whole = lambda u: F.floor(scale * u.cast("double"))
    sound = F.forall(x, lambda u: u.isNotNull() & (F.abs(u.cast("double")) < MOST / scale - 1))
    use = rows.where(F.col(id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & sound)
    return use.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.transform(x, whole).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))


def limits(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest integer of every dimension, 0 included; tasks reduce their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = np.zeros(0, dtype=np.int64)
        for b in batches:
            if len(b):
                x = padded(b.column("v"), max(len(low), int(np.diff(b.column("v").offsets.to_numpy()).max())))
                grown = np.zeros(x.shape[1] - len(low), dtype=np.int64)
                low = np.minimum(np.append(low, grown), x.min(axis=0))
                high = np.maximum(np.append(high, grown), x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high)], ["d", "low", "high"])

    found = vectors.select("v").mapInArrow(run, "d int, low bigint, high bigint").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = sorted(found.collect())  # a row for each dimension
    return np.array([min(r.low, 0) for r in rows], dtype=np.int64), np.array([max(r.high, 0) for r in rows], dtype=np.int64)


def padded(v: pa.Array, width: int) -> np.ndarray:
    """A row for each vector, padded with zeros."""
    sizes = np.diff(v.offsets.to_numpy())
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = v.flatten().to_numpy()
    return out


def approximations(vectors: DataFrame, low: np.ndarray, high: np.ndarray, cells: int = CELLS) -> DataFrame:
    """id, label, anchor, cells, exact: the file. ``exact`` are 32-bit integers."""
    width = cell_widths(low, high, cells)

    def run(batches):
        for b in batches:
            x = padded(b.column("v"), len(low))
            code = ((x - low) // width).astype(np.uint8)
            raw = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("anchor"), raw(code), raw(x.astype(np.int32))], ["id", "label", "anchor", "cells", "exact"])

    return vectors.mapInArrow(run, "id bigint, label bigint, anchor boolean, cells binary, exact binary")


def cell_widths(low: np.ndarray, high: np.ndarray, cells: int) -> np.ndarray:
    return np.maximum(1, -(-(high - low + 1) // cells))


class Tile:
    """Rows of one tile in order of label, and bounds of an anchor batch against them."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cells: int):
        self.low, self.width, self.cells = low, cell_widths(low, high, cells), cells
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, b: pa.RecordBatch) -> None:
        self.parts.append((*[b.column(c).to_numpy() for c in ("row", "id", "label")], matrix(b.column("cells"), np.uint8, len(self.low)), matrix(b.column("exact"), np.int32, len(self.low))))

    def close(self) -> None:
        row, id, label, code, exact = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(label, kind="stable")
        self.row, self.id, self.label, self.code, self.exact = row[order], id[order], label[order], np.ascontiguousarray(code[order].T), exact[order]

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.label, [label, label + 1]).tolist())

    def bounds(self, anchors: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """The lower bounds of the anchors' scores with the rows, and each anchor's margin up to the upper bounds."""
        starts = self.low + np.arange(self.cells)[:, None] * self.width
        ends = starts + self.width - 1
        least = np.minimum(anchors[:, None, :] * starts, anchors[:, None, :] * ends)  # anchor, cell, dimension
        out = np.zeros((len(anchors), len(self.row[rows])), dtype=np.int64)
        for d in range(len(self.low)):
            out += np.take(np.ascontiguousarray(least[:, :, d]), self.code[d, rows], axis=1)
        return out, (np.abs(anchors) * (self.width - 1)).sum(axis=1)

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.exact[at].astype(np.int64) @ anchor


def matrix(raw: pa.Array, kind, width: int) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    if not width or not len(raw):
        return np.zeros((len(raw), width), dtype=kind)
    _, offsets, data = raw.buffers()
    start = int(np.frombuffer(offsets, dtype=np.int32)[raw.offset])
    return np.frombuffer(data, dtype=kind, count=len(raw) * width, offset=start).reshape(len(raw), width)


def best(scores: np.ndarray, id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by score down, then id, then row."""
    return np.lexsort((row, id, -scores))[:k]


def top_bound(bounds: np.ndarray, k: int) -> int | None:
    """The k-th greatest, None where there are fewer."""
    return int(np.partition(bounds, len(bounds) - k)[len(bounds) - k]) if len(bounds) >= k else None


def positives_in(tile: Tile, keys: np.ndarray, labels: np.ndarray, anchors: np.ndarray, k: int) -> Iterator[tuple]:
    """(anchor, score, id, row) of a tile's best rows of the anchors' labels."""
    for label in np.unique(labels):
        own = tile.of_label(label)
        if own.start == own.stop:
            continue
        at = np.flatnonzero(labels == label)
        low, margin = tile.bounds(anchors[at], own)
        for i, a in enumerate(at):
            other = tile.row[own] != keys[a]
            least = top_bound(low[i][other], k)
            near = own.start + np.flatnonzero(other if least is None else other & (low[i] + margin[i] >= least))
            score = tile.scores(anchors[a], near)
            for j in best(score, tile.id[near], tile.row[near], k):
                yield keys[a], None, score[j], tile.id[near[j]], tile.row[near[j]]


def negatives_in(tile: Tile, keys: np.ndarray, labels: np.ndarray, anchors: np.ndarray, windows: list[list[int]], k: int, low_share: int, high_share: int) -> Iterator[tuple]:
    """(anchor, positive score, score, id, row) of a tile's best rows of other labels in every window."""
    low, margin = tile.bounds(anchors, slice(0, len(tile.row)))
    for a in range(len(keys)):
        own = tile.of_label(labels[a])
        other = np.ones(len(tile.row), dtype=bool)
        other[own] = False
        up = low[a] + margin[a]
        spans = [(p, -((-low_share * p) // 100), high_share * p // 100) for p in windows[a]]
        spans = [s for s in spans if s[1] <= s[2]]
        near = np.zeros(len(tile.row), dtype=bool)
        for _, start, end in spans:
            may = other & (up >= start) & (low[a] <= end)
            least = top_bound(low[a][may & (low[a] >= start) & (up <= end)], k)
            near |= may if least is None else may & (up >= least)
        at = np.flatnonzero(near)
        score = tile.scores(anchors[a], at)
        for p, start, end in spans:
            within = np.flatnonzero((score >= start) & (score <= end))
            for j in within[best(score[within], tile.id[at[within]], tile.row[at[within]], k)]:
                yield keys[a], p, score[j], tile.id[at[j]], tile.row[at[j]]


FOUND = "anchor bigint, positive_score bigint, score bigint, id bigint, row bigint"


def searched(file: DataFrame, anchors: DataFrame, tiles: int, low: np.ndarray, high: np.ndarray, cells: int, find) -> DataFrame:
    """``find`` over every tile and batch of anchors. ``file`` has row, id, label, cells, exact; ``anchors`` these
    and windows."""
    spread = F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int")
    none = F.lit(None).cast("array<bigint>")
    one = file.select(spread.alias("tile"), F.lit(0).alias("kind"), "row", "id", "label", "cells", "exact", none.alias("windows"))
    two = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.lit(1).alias("kind"), "row", "id", "label", "cells", "exact", "windows")
    dealt = one.unionByName(two).repartition(tiles, "tile").sortWithinPartitions("tile", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, tile, closed = None, None, False
        for whole in batches:
            tile_of, kind = whole.column("tile").to_numpy(), whole.column("kind").to_numpy()
            edges = np.flatnonzero(np.diff(tile_of) | np.diff(kind)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(kind)], strict=True):
                if start == end:
                    continue
                b = whole.slice(start, end - start)
                if tile_of[start] != number:
                    number, tile, closed = tile_of[start], Tile(low, high, cells), False
                if kind[start] == 0:
                    tile.add(b)
                    continue
                if not tile.parts:
                    continue
                if not closed:
                    tile.close()
                    closed = True
                step = max(1, min(256, PAIRS // len(tile.row)))
                for at in range(0, len(b), step):
                    part = b.slice(at, step)
                    found = list(find(tile, part.column("row").to_numpy(), part.column("label").to_numpy(), matrix(part.column("exact"), np.int32, len(low)).astype(np.int64), part.column("windows").to_pylist()))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([None if x is None else int(x) for x in c], pa.int64()) for c in zip(*found, strict=True)], ["anchor", "positive_score", "score", "id", "row"])

    return dealt.mapInArrow(run, FOUND)


def mine(
    rows: DataFrame, anchor: Column, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5,
    low_share: int = 80, high_share: int = 100, scale: int = 256, cells: int = CELLS, tile: int = TILE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` tells the anchors. A positive is one of the first ``positives`` other rows of the anchor's label, a
    negative one of the first ``negatives`` rows of another label with low_share * positive_score <= 100 *
    negative_score <= high_share * positive_score; scores are inner products of the integers floor(scale * x).
    """
    if not 1 <= cells <= 256:
        raise ValueError("a cell is a byte")
    # Rows get a number of their own once, here, and keep it.
    vectors = written(integers(rows, id, vector, label, anchor, scale))
    low, high = limits(vectors)
    file = written(approximations(vectors, low, high, cells).withColumn("row", F.monotonically_increasing_id()))
    tiles = max(file.sparkSession.sparkContext.defaultParallelism, -(-file.count() // tile))
    own = file.where("anchor").select("row", "id", "label", "cells", "exact")
    args = (tiles, low, high, cells)

    near = searched(file, own.withColumn("windows", F.lit(None).cast("array<bigint>")), *args, lambda t, keys, labels, x, _: positives_in(t, keys, labels, x, positives))
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    pairs = written(near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives).select("anchor", "id", "score"))

    # A few windows for each anchor.
    windows = pairs.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("score").alias("windows"))
    find = lambda t, keys, labels, x, w: negatives_in(t, keys, labels, x, w, negatives, low_share, high_share)
    far = searched(file, own.join(windows, "row"), *args, find)
    order = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "id", "row")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    names = own.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    named = pairs.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, "anchor")
    return ranked.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(named, ["anchor", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
