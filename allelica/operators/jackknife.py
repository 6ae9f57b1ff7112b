"""Weighted delete-one-block jackknife over block sums, in SQL windows and in numpy for vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jackknife(blocks: DataFrame, keys: list[str], full: Column, without: Column, weight: str = "n", least: float = 1e-6) -> DataFrame:
    """keys, est, jack (jackknife mean), se, blocks.

    ``blocks`` has a row per key and block, ``full`` and ``without`` are the estimate from all blocks and
    from all but a row's own; block totals by subtraction are the caller's. Blocks of no weight are dropped;
    fewer than two give a null error.
    """
    own = Window.partitionBy(*keys)
    rows = blocks.withColumns({"__full": full, "__without": without}).where(F.col(weight) > least)
    rows = rows.withColumn("__total", F.sum(weight).over(own))
    h = F.col("__total") / F.col(weight)
    rows = rows.withColumn("__h", h)
    mean = F.sum(F.col("__full") - F.col("__without")).over(own) + F.sum(F.col(weight) * F.col("__without")).over(own) / F.col("__total")
    rows = rows.withColumn("__mean", mean)
    tau = F.col("__h") * F.col("__full") - (F.col("__h") - 1) * F.col("__without")
    term = (tau - F.col("__mean")) * (tau - F.col("__mean")) / (F.col("__h") - 1)
    return rows.groupBy(*keys).agg(
        F.max("__full").alias("est"), F.max("__mean").alias("jack"),
        F.when(F.count("*") >= 2, F.sqrt(F.sum(term) / F.count("*"))).alias("se"), F.count("*").cast("bigint").alias("blocks"),
    )


def ratio(blocks: DataFrame, keys: list[str], top: str = "top", bot: str = "bot", weight: str = "n") -> DataFrame:
    """Jackknife of sum(top) / sum(bot)."""
    own = Window.partitionBy(*keys)
    rows = blocks.withColumns({"__top": F.sum(top).over(own), "__bot": F.sum(bot).over(own)})
    return jackknife(rows, keys, F.col("__top") / F.col("__bot"), F.try_divide(F.col("__top") - F.col(top), F.col("__bot") - F.col(bot)), weight)


def trimmed(blocks: DataFrame, keys: list[str], share: float, top: str = "top", bot: str = "bot", weight: str = "n") -> DataFrame:
    """keys, est, jack, se, blocks of sum(top) / sum(bot) from the blocks whose delete-one estimates lie in the middle: of
    each end the nearest whole number to ``share`` of the blocks is left out. The error is that of all blocks; ties in
    12 digits go by block; ``blocks`` counts those kept."""
    own = Window.partitionBy(*keys)
    rows = blocks.where(F.col(weight) > 1e-6).withColumns({"__top": F.sum(top).over(own), "__bot": F.sum(bot).over(own)})
    less = F.round(F.try_divide(F.col("__top") - F.col(top), F.col("__bot") - F.col(bot)), 12)
    rows = rows.withColumn("__rank", F.row_number().over(own.orderBy(less, "block"))).withColumn("__count", F.count("*").over(own))
    out = F.floor(F.col("__count") * F.lit(share) + 0.5)
    kept = rows.where((F.col("__rank") > out) & (F.col("__rank") <= F.col("__count") - out)).drop("__top", "__bot")
    error = ratio(blocks, keys, top, bot, weight).select(*keys, "se")
    return ratio(kept, keys, top, bot, weight).drop("se").join(error, keys).select(*keys, "est", "jack", "se", "blocks")


def z_score(mean: Column, se: Column, most: float = 100.0) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), F.try_divide(mean, se)))


def vector(without: np.ndarray, full: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jackknife mean and covariance of a vector: ``without`` has a row per deleted block."""
    keep = weights > 1e-6
    w, x = weights[keep], without[keep]
    n = w.sum()
    h = n / w
    mean = (full - x).sum(axis=0) + (w[:, None] * x).sum(axis=0) / n
    tau = h[:, None] * full - (h - 1)[:, None] * x
    d = (tau - mean) / np.sqrt(h - 1)[:, None]
    return mean, d.T @ d / len(w)


@dataclass
class Covariance:
    """Jackknife mean and covariance of several statistics over common blocks; ``full`` are the estimates themselves."""

    mean: np.ndarray
    cov: np.ndarray
    full: np.ndarray
    blocks: int
    effective: float


def covariance(sums: DataFrame, k: int, top: str = "top", weight: str = "n") -> Covariance:
    """Of the ratios sum(top) / sum(weight) of statistics 0 to k - 1 from rows (qid, block, top, weight), as ``vector``
    gives it; a block's weight is the mean of the statistics', and what a block lacks counts as zero.

    Blocks are brought together by block, tasks add up outer products of their blocks' pseudo-values, and k by k numbers
    leave the cluster. Pseudo-values are taken about the full estimate, so the products lose no digits.
    """
    spark = sums.sparkSession
    total_top, total = np.zeros(k), np.zeros(k)
    for r in sums.groupBy("qid").agg(F.sum(top).alias("t"), F.sum(weight).alias("w")).collect():  # a row for each statistic
        total_top[r.qid], total[r.qid] = r.t, r.w
    with np.errstate(invalid="ignore", divide="ignore"):
        full = total_top / total
    sent, whole = spark.sparkContext.broadcast((total_top, total, full)), total.mean()
    blocks = sums.groupBy("block").agg(F.collect_list(F.struct("qid", F.col(top).cast("double").alias("t"), F.col(weight).cast("double").alias("w"))).alias("x"))

    def run(batches):
        t_all, w_all, est = sent.value
        outer, cross, shift, scale = np.zeros((k, k)), np.zeros(k), np.zeros(k), np.zeros(3)
        for b in batches:
            x = b.column("x")
            flat, row = x.flatten(), np.repeat(np.arange(len(b)), np.diff(x.offsets.to_numpy()))
            t, w = np.zeros((len(b), k)), np.zeros((len(b), k))
            t[row, flat.field("qid").to_numpy()], w[row, flat.field("qid").to_numpy()] = flat.field("t").to_numpy(), flat.field("w").to_numpy()
            own = w.mean(axis=1)
            keep = own > 1e-6
            t, w, own = t[keep], w[keep], own[keep]
            less = (t_all - t) / (w_all - w) - est
            h = whole / own
            tau = -(h - 1)[:, None] * less / np.sqrt(h - 1)[:, None]
            outer += tau.T @ tau
            cross += (tau / np.sqrt(h - 1)[:, None]).sum(axis=0)
            shift += (own[:, None] * less).sum(axis=0) / whole - less.sum(axis=0)
            scale += (len(own), (1 / (h - 1)).sum(), (own * own).sum())
        i, j = np.divmod(np.arange(k * k), k)
        rows = [(i, j, outer.ravel()), (np.arange(k), np.full(k, -1), cross), (np.arange(k), np.full(k, -2), shift), (np.full(3, -1), np.arange(3), scale)]
        a, b, v = (np.concatenate(c) for c in zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(v)], ["i", "j", "v"])

    found = blocks.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    value = {(r.i, r.j): r.v for r in found}
    at = lambda j: np.array([value[i, j] for i in range(k)])
    outer, cross, shift = np.array([[value[i, j] for j in range(k)] for i in range(k)]), at(-1), at(-2)
    g, scale, squares = (value.get((-1, c), 0.0) for c in range(3))
    cov = (outer - np.outer(cross, shift) - np.outer(shift, cross) + scale * np.outer(shift, shift)) / max(g, 1)
    return Covariance(full + shift, cov, full, int(g), whole * whole / squares if squares else 0.0)


def effective_blocks(weights: np.ndarray) -> float:
    share = weights / weights.sum()
    return float(1 / (share * share).sum())


def fourier(full: float, without: np.ndarray, weights: np.ndarray) -> tuple[float, float, float]:
    """(mean, error, lag-one correlation) for blocks in genome order, ``without`` the estimate less each block.

    rho is the circular lag-one correlation of the centred estimates over the square roots of their weights.
    Below 0 the plain jackknife stands. Else the estimates are whitened by the circulant kernel c whose
    spectrum is (1 + 2 rho cos(2 pi k / g)) to the power -1/2, scaled to sum 1; a whitened block's weight is
    the sum of c_k^2 w and of the lag-one terms c_k c_(k+1) rho sqrt(w w'), scaled to mean 1. A spectrum that
    is not positive, at rho of a half and more, has no such kernel: the error is not a number.
    """
    w, x = weights.astype(float) + 1e-20, without.astype(float)
    g, centre = len(w), without.mean()
    scaled = (x - centre) / np.sqrt(w)
    pair = np.corrcoef(scaled, np.roll(scaled, -1))[0, 1]
    rho = float(pair) if pair == pair else 0.0
    if rho < 0:
        return (*_plain(full, x, w), 0.0)
    spectrum = 1 + 2 * rho * np.cos(2 * np.pi * np.arange(g) / g)
    if (spectrum <= 0).any():
        return full, float("nan"), rho
    kernel = np.fft.ifft(spectrum**-0.5).real
    kernel /= kernel.sum()
    turn = lambda a, b: np.fft.ifft(np.fft.fft(a) * np.fft.fft(b)).real
    cross = rho * np.sqrt(w * np.roll(w, -1))
    # Sums over k of c_k c_(k+1) q at k places further on.
    new = turn(kernel**2, w) + np.fft.ifft(np.conj(np.fft.fft(kernel * np.roll(kernel, -1))) * np.fft.fft(cross)).real
    return (*_plain(full, turn(kernel, x - centre) + centre, new / new.mean()), rho)


def _plain(full: float, without: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    mean, cov = vector(without[:, None], np.array([full]), weights)
    return float(mean[0]), float(np.sqrt(cov[0, 0]))
