"""Small dense back end on collected block sums: covariance shrinkage, rank tests, admixture weights, decay fits.

The data-sized work ends in a block-sum table (blocks times statistics); what follows are matrices of tens to
a few thousand rows, in numpy on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame

from allelica.functions.tails import chi_square_tail
from allelica.operators.jackknife import vector


def f4_matrix(block_sums: DataFrame, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(X, V, deleted, weights) from (qid, block, top, n): X is rows by cols, V the covariance of its entries
    row by row, deleted the X of each left-out block."""
    pdf = block_sums.toPandas()
    k = rows * cols
    top = pdf.pivot_table(index="block", columns="qid", values="top", fill_value=0.0).reindex(columns=range(k), fill_value=0.0).to_numpy()
    n = pdf.pivot_table(index="block", columns="qid", values="n", fill_value=0.0).reindex(columns=range(k), fill_value=0.0).to_numpy()
    full = top.sum(axis=0) / n.sum(axis=0)
    without = (top.sum(axis=0) - top) / (n.sum(axis=0) - n)
    weights = n.mean(axis=1)
    mean, cov = vector(without, full, weights)
    return mean.reshape(rows, cols), cov, without.reshape(-1, rows, cols), weights


def shrink(cov: np.ndarray, n: float) -> np.ndarray:
    """Oracle-approximating shrinkage towards a multiple of the identity."""
    p = len(cov)
    t, t2 = np.trace(cov), np.trace(cov @ cov)
    rho = min(1.0, ((1 - 2 / p) * t2 + t * t) / ((n + 1 - 2 / p) * t2 + (n + 1 - p) * t * t / p))
    return (1 - rho) * cov + rho * t / p * np.eye(p)


def rank_dof(m: int, n: int, r: int) -> int:
    """Degrees of freedom left when an m by n matrix has rank r."""
    return m * n - r * (m + n) + r * r


@dataclass
class RankTest:
    rank: int
    dof: int
    chi_square: float
    tail: float
    a: np.ndarray
    b: np.ndarray


def rank_test(x: np.ndarray, cov: np.ndarray, rank: int, rounds: int = 20) -> RankTest:
    """Least weighted distance of X from the matrices of a rank, by alternating least squares from the SVD."""
    m, n = x.shape
    inverse = np.linalg.pinv(cov, hermitian=True)
    u, s, vt = np.linalg.svd(x)
    a, b = u[:, :rank] * s[:rank], vt[:rank]
    flat = x.ravel()
    for _ in range(rounds if rank else 0):
        d = np.kron(np.eye(m), b.T)  # entries of AB by entries of A
        a = np.linalg.lstsq(d.T @ inverse @ d, d.T @ inverse @ flat, rcond=None)[0].reshape(m, rank)
        d = np.kron(a, np.eye(n))
        b = np.linalg.lstsq(d.T @ inverse @ d, d.T @ inverse @ flat, rcond=None)[0].reshape(rank, n)
    left = flat - (a @ b).ravel()
    score, dof = float(left @ inverse @ left), rank_dof(m, n, rank)
    return RankTest(rank, dof, score, chi_square_tail(score, dof), a, b)


def admixture_weights(x: np.ndarray, cov: np.ndarray, zero: tuple[int, ...] = ()) -> tuple[np.ndarray, float, int]:
    """(weights, chi-square, degrees of freedom) of a target as a mixture of sources.

    Rows of X are f4(target, source; R0, Rj). The weights sum to 1 and minimise the weighted square of their
    combination of rows; sources in ``zero`` have weight 0. The metric is refitted at each round's weights.
    """
    sources, n = x.shape
    free = [k for k in range(sources) if k not in zero]
    w = np.full(len(free), 1 / len(free))
    blocks = cov.reshape(sources, n, sources, n)[np.ix_(free, range(n), free, range(n))]
    y = x[free]
    score = 0.0
    for _ in range(50):
        metric = np.linalg.pinv(np.einsum("i,ikjl,j->kl", w, blocks, w), hermitian=True)
        c = y @ metric @ y.T
        new = np.linalg.pinv(c, hermitian=True) @ np.ones(len(free))
        new /= new.sum()
        step, w = np.abs(new - w).max(), new
        score = float((w @ y) @ metric @ (w @ y))
        if step < 1e-12:
            break
    out = np.zeros(sources)
    out[free] = w
    return out, score, n - len(free) + 1


def weight_errors(deleted: np.ndarray, full: np.ndarray, cov: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jackknife errors and covariance of the weights from the X of each left-out block."""
    without = np.array([admixture_weights(x, cov)[0] for x in deleted])
    _, spread = vector(without, full, weights)
    return np.sqrt(np.diag(spread)), spread


def sub_models(x: np.ndarray, cov: np.ndarray, least: float = -0.001) -> list[dict]:
    """All patterns of sources fixed at zero but the empty one, each with its weights, fit and feasibility."""
    out = []
    for pattern in product((0, 1), repeat=len(x)):
        zero = tuple(k for k, v in enumerate(pattern) if v)
        if len(zero) == len(x):
            continue
        w, score, dof = admixture_weights(x, cov, zero)
        out.append({"pattern": "".join(map(str, pattern)), "weights": w, "chisq": score, "dof": dof, "tail": chi_square_tail(score, dof), "feasible": bool((w >= least).all())})
    return sorted(out, key=lambda m: (sum(map(int, m["pattern"])), m["pattern"]))


def exponential_fit(d: np.ndarray, y: np.ndarray, constant: bool = True, rounds: int = 200) -> tuple[float, float, float]:
    """(C, A, m) of y = C + A exp(-m d): a grid of rates with linear least squares, then Gauss-Newton. A rate whose
    exponentials pass a double is no better than any other."""

    def linear(m: float) -> tuple[float, float, float]:
        with np.errstate(over="ignore"):
            e = np.exp(-m * d)
            size = e @ e
        if not np.isfinite(size):
            return np.inf, 0.0, 0.0
        design = np.column_stack([np.ones_like(d), e]) if constant else e[:, None]
        c = np.linalg.lstsq(design, y, rcond=None)[0]
        left = y - design @ c
        return (float(left @ left), float(c[0]) if constant else 0.0, float(c[-1]))

    m = min(np.geomspace(0.1, 1000, 200) / max(d.max(), 1e-12), key=lambda r: linear(r)[0])
    _, c, a = linear(m)
    for _ in range(rounds):
        e = np.exp(-m * d)
        columns = [e, -a * d * e] if not constant else [np.ones_like(d), e, -a * d * e]
        step = np.linalg.lstsq(np.column_stack(columns), y - c - a * e, rcond=None)[0]
        scale, best = 1.0, linear(m)[0]
        while scale > 1e-6 and linear(m + scale * step[-1])[0] > best:
            scale /= 2
        if linear(m + scale * step[-1])[0] == np.inf:
            break
        m += scale * step[-1]
        _, c, a = linear(m)
        if abs(scale * step[-1]) < 1e-12 * abs(m):
            break
    return c, a, float(m)


def mixture(block_sums: DataFrame, sources: int) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, errors) that sum to 1 and lie along M^-1 1, M the symmetric matrix of f(target, b; target, c)
    whose upper triangle, row by row, are the statistics; errors by jackknife over blocks."""
    pdf = block_sums.toPandas()
    k = sources * (sources + 1) // 2
    grid = lambda c: pdf.pivot_table(index="block", columns="qid", values=c, fill_value=0.0).reindex(columns=range(k), fill_value=0.0).to_numpy(dtype=float)
    top, n = grid("top"), grid("n")
    upper = np.triu_indices(sources)

    def solve(sums: np.ndarray) -> np.ndarray:
        m = np.zeros((sources, sources))
        m[upper] = sums
        w = np.linalg.solve(m + np.triu(m, 1).T, np.ones(sources))
        return w / w.sum()

    full = solve(top.sum(axis=0) / n.sum(axis=0))
    without = np.array([solve((top.sum(axis=0) - t) / (n.sum(axis=0) - w)) for t, w in zip(top, n, strict=True)])
    mean, cov = vector(without, full, n[:, 0])
    return mean, np.sqrt(np.diag(cov))


def dates(whole, own, sizes, width: float, chroms: list[int] | None = None) -> tuple[list[tuple[int | None, float | None]], float | None]:
    """Decay rates per Morgan of the whole table (bin, regression) and of those without each chromosome (chrom, bin,
    regression), and the jackknife error with the chromosomes' markers as weights. ``chroms`` are the chromosomes with
    pairs, of which one alone has no row in ``own``.

    A table with fewer bins than the curve has parameters fits any rate: it has none, and there is no error unless every
    table has a rate and two chromosomes have pairs."""

    def rate(table) -> float | None:
        t = table.dropna(subset=["regression"]).sort_values("bin")
        if t["bin"].nunique() < 3:
            return None
        return float(exponential_fit((t["bin"].to_numpy(float) + 0.5) * width, t["regression"].to_numpy(float))[2])

    full, chroms = rate(whole), sorted(own["chrom"].unique()) if chroms is None else chroms
    less = [rate(own[own["chrom"] == c]) for c in chroms]
    rows = [(None, full), *[(int(c), v) for c, v in zip(chroms, less, strict=True)]]
    if len(less) < 2 or any(v is None for _, v in rows):
        return rows, None
    _, cov = vector(np.array(less)[:, None], np.array([full]), np.array([sizes[c] for c in chroms], dtype=float))
    return rows, float(np.sqrt(cov[0, 0]))
