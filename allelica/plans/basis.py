"""The f-statistic basis: all statistics regressed on f3(base; a, b), its covariance, its file, and evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelica.operators import fstats, jackknife
from allelica.operators.jackknife import effective_blocks, vector


def pairs(pops: Sequence[str]) -> list[tuple[str, str]]:
    """The basis: pairs a <= b of the populations after the base."""
    return [(a, b) for i, a in enumerate(pops[1:]) for b in pops[1 + i :]]


def coefficients(quad: Sequence[str], pops: Sequence[str]) -> np.ndarray:
    """f(a, b; c, d) = B(a, c) + B(b, d) - B(a, d) - B(b, c), where B with the base is 0."""
    place = {frozenset(p): k for k, p in enumerate(pairs(pops))}
    out = np.zeros(len(place))
    a, b, c, d = quad
    for x, y, sign in ((a, c, 1), (b, d, 1), (a, d, -1), (b, c, -1)):
        if pops[0] not in (x, y):
            out[place[frozenset((x, y))]] += sign
    return out


def statistics(pops: Sequence[str]) -> fstats.AllStatistics:
    """Every f2, f3 and f4 of the populations, each once, by number."""
    return fstats.AllStatistics(pops)


@dataclass
class Basis:
    pops: list[str]
    mean: np.ndarray
    cov: np.ndarray
    blocks: int
    effective: float

    def evaluate(self, quads: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Means and covariance of any statistics of the populations."""
        c = np.array([coefficients(q, self.pops) for q in quads])
        return c @ self.mean, c @ self.cov @ c.T

    def dump(self) -> str:
        """The basis as text: means times 1000, covariances times a million."""
        names = pairs(self.pops)
        lines = [f"##fbasis. basepop: {self.pops[0]} nblocks: {self.blocks} effblocks: {self.effective:.3f}"]
        lines += [f"{a:>20} {b:>20} {1000 * m:.12f}" for (a, b), m in zip(names, self.mean, strict=True)]
        lines += [f"{a:>20} {b:>20} {c:>20} {d:>20} {1e6 * self.cov[i, j]:.12f}" for i, (a, b) in enumerate(names) for j, (c, d) in enumerate(names) if j >= i]
        return "\n".join(lines) + "\n"

    @classmethod
    def load(cls, text: str) -> Basis:
        head, *rest = text.splitlines()
        words = head.split()
        value = lambda key: words[words.index(key) + 1]
        rows = [r.split() for r in rest if r.strip()]
        order = list(dict.fromkeys(r[0] for r in rows if len(r) == 3))
        pops = [value("basepop:"), *order]
        place = {frozenset(p): k for k, p in enumerate(pairs(pops))}
        mean, cov = np.zeros(len(place)), np.zeros((len(place), len(place)))
        for r in rows:
            if len(r) == 3:
                mean[place[frozenset(r[:2])]] = float(r[2]) / 1000
            else:
                i, j = place[frozenset(r[:2])], place[frozenset(r[2:4])]
                cov[i, j] = cov[j, i] = float(r[4]) / 1e6
        return cls(pops, mean, cov, int(value("nblocks:")), float(value("effblocks:")))


def fit(markers: DataFrame, pops: Sequence[str]) -> Basis:
    """Weighted least squares of all statistics on the basis, over all blocks and with each block left out.

    A statistic's weight is the inverse of its error, drawn a little to 1: s'^2 = (s^2 n + 1) / (n + 1). The weights are
    those of all blocks, so one matrix is solved; blocks differ in the right side of their normal equations, which tasks
    sum up. Blocks times basis numbers reach the driver, and no statistic.
    """
    quads, names = statistics(pops), pairs(pops)
    k, spark = len(names), markers.sparkSession
    sums = fstats.general_blocks(markers, quads)
    sums = sums.checkpoint() if spark.sparkContext.getCheckpointDir() else sums
    per = sorted((r.block, r.w) for r in sums.groupBy("block").agg((F.sum("n") / len(quads)).alias("w")).collect())
    order, weights = {b: i for i, (b, _) in enumerate(per)}, np.array([w for _, w in per])
    own = jackknife.ratio(sums, ["qid"]).select("qid", "est", (F.col("se") * F.col("se")).alias("var"))
    g, mean = len(weights), own.agg(F.avg("var")).first()[0]
    own = own.select("qid", "est", (F.lit(g + 1.0) / (F.col("var") * g + mean)).alias("weight"))
    # The right side of a block's normal equations: only statistics that the block holds differ from the full ones.
    total = sums.groupBy("qid").agg(F.sum("top").alias("all_top"), F.sum("n").alias("all_n"))
    rows = sums.join(total, "qid").join(own, "qid")
    less = (F.col("all_top") - F.col("top")) / (F.col("all_n") - F.col("n")) - F.col("est")
    changed = _projected(rows.select("qid", "block", (F.col("weight") * less).alias("v")), quads, names, "block").collect()
    whole = _projected(own.select("qid", F.lit(0).cast("bigint").alias("block"), (F.col("weight") * F.col("est")).alias("v")), quads, names, "block").collect()
    normal = _normal(own.select("qid", "weight"), quads, names).collect()
    solve = np.zeros((k, k))
    for r in normal:
        solve[r.i, r.j] = r.v
    solve = np.linalg.pinv(solve, hermitian=True)
    right, shift = np.zeros(k), np.zeros((g, k))
    for r in whole:
        right[r.i] = r.v
    for r in changed:
        shift[order[r.block], r.i] = r.v
    full = solve @ right
    mean, cov = vector(full + shift @ solve, full, weights)
    return Basis(list(pops), mean, cov, g, effective_blocks(weights))


def _design(places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(basis places, signs) of statistics, four of each to a row; sign 0 where a term has the base. Population 0 is the
    base, and a <= b of the others stand in the order of ``pairs``."""
    n = int((np.sqrt(8 * k + 1) - 1) / 2)  # populations after the base
    q = places - 1
    terms = [(0, 2, 1), (1, 3, 1), (0, 3, -1), (1, 2, -1)]
    low = np.stack([np.minimum(q[:, i], q[:, j]) for i, j, _ in terms], axis=1)
    high = np.stack([np.maximum(q[:, i], q[:, j]) for i, j, _ in terms], axis=1)
    sign = np.where(low < 0, 0, np.array([s for _, _, s in terms]))
    low, high = np.maximum(low, 0), np.maximum(high, 0)
    return low * n - low * (low - 1) // 2 + high - low, sign


def _places(quads, qid: np.ndarray) -> np.ndarray:
    """The places of statistics by number; runs of numbers are taken together."""
    own, back = np.unique(qid, return_inverse=True)
    runs = np.split(own, np.flatnonzero(np.diff(own) > 1) + 1) if len(own) else []
    return np.concatenate([quads.take(int(r[0]), int(r[-1]) + 1) for r in runs])[back] if len(own) else np.zeros((0, 4), dtype=np.int64)


def _projected(rows: DataFrame, quads, names: list, key: str) -> DataFrame:
    """key, i, v: sums over statistics of their values times the design; a statistic's row is made from its number in the
    task, which adds up by key before the shuffle."""
    k = len(names)

    def run(batches):
        for b in batches:
            at, sign = _design(_places(quads, b.column("qid").to_numpy()), k)
            own, back = np.unique(b.column(key).to_numpy(), return_inverse=True)
            out = np.zeros((len(own), k))
            np.add.at(out, (np.repeat(back, 4), at.ravel()), (sign * b.column("v").to_numpy()[:, None]).ravel())
            i, j = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(j.astype(np.int32)), pa.array(out[i, j])], [key, "i", "v"])

    return rows.mapInArrow(run, f"{key} bigint, i int, v double").groupBy(key, "i").agg(F.sum("v").alias("v"))


def _normal(rows: DataFrame, quads, names: list) -> DataFrame:
    """i, j, v: the design's products weighted by statistic, at most sixteen entries each."""
    k = len(names)

    def run(batches):
        for b in batches:
            at, sign = _design(_places(quads, b.column("qid").to_numpy()), k)
            out = np.zeros((k, k))
            value = sign[:, :, None] * sign[:, None, :] * b.column("weight").to_numpy()[:, None, None]
            np.add.at(out, (np.repeat(at, 4, axis=1).ravel(), np.tile(at, (1, 4)).ravel()), value.ravel())
            i, j = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(out[i, j])], ["i", "j", "v"])

    return rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def joint_test(f: np.ndarray, cov: np.ndarray) -> tuple[float, int]:
    """T squared that all the statistics are 0, and its degrees of freedom: the rank of their covariance."""
    values, vectors = np.linalg.eigh(cov)
    keep = values > 1e-10 * max(values.max(), 0)
    turned = vectors[:, keep].T @ f
    return float((turned * turned / values[keep]).sum()), int(keep.sum())
