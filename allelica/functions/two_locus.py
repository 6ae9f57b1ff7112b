"""Two-locus statistics of 3 x 3 genotype tables, many tables at once: haplotype frequencies by EM, likelihood ratios,
D', and the logistic test of interaction between two markers.

A table is nine counts, cell 3 * g1 + g2 for g copies of the reference allele at the first and second marker; haplotype
2 * a + b carries a and b of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Steps of the EM at most, the gain in log likelihood below which it stops, a floor of probabilities.
STEPS, GAIN, FLOOR = 10, 1e-3, 1e-20
#: Fixed value: calls that a table needs.
LEAST = 2.5


@dataclass
class Linkage:
    ratio: np.ndarray  # twice the gain in log likelihood by linkage
    z: np.ndarray  # its root, negative where haplotype 0 is rarer than by chance
    dprime: np.ndarray
    haplotypes: np.ndarray  # a row of four frequencies for each table


def cell_probabilities(p: np.ndarray) -> np.ndarray:
    """Nine genotype probabilities for each row of four haplotype frequencies."""
    a, b, c, d = p.T
    return np.stack([a * a, 2 * a * b, b * b, 2 * a * c, 2 * (a * d + b * c), 2 * b * d, c * c, 2 * c * d, d * d], axis=1) + FLOOR


def log_likelihood(tables: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (tables * np.log(cell_probabilities(p))).sum(axis=1)


def expected_haplotypes(tables: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Haplotype counts: all follow from the genotypes but those of double heterozygotes, shared out by ``p``."""
    t = tables.T
    known = np.stack([2 * t[0] + t[1] + t[3], 2 * t[2] + t[1] + t[5], 2 * t[6] + t[3] + t[7], 2 * t[8] + t[5] + t[7]])
    coupled, crossed = p[:, 0] * p[:, 3], p[:, 1] * p[:, 2]
    whole = 2 * (coupled + crossed) + FLOOR
    return (known + t[4] * 2 * np.stack([coupled, crossed, crossed, coupled]) / whole).T


def independent(tables: np.ndarray) -> np.ndarray:
    """Haplotype frequencies without linkage: products of the two markers' allele frequencies."""
    grid = tables.reshape(-1, 3, 3)
    share = lambda x: (x[:, 1] / 2 + x[:, 2]) / x.sum(axis=1)
    a, b = share(grid.sum(axis=2)), share(grid.sum(axis=1))
    return np.stack([(1 - a) * (1 - b), (1 - a) * b, a * (1 - b), a * b], axis=1)


def d_prime(p: np.ndarray) -> np.ndarray:
    """The size of D over the greatest that the allele frequencies allow, 0 where one of the markers does not vary."""
    x, a, b = p[:, 0], p[:, 0] + p[:, 1], p[:, 0] + p[:, 2]
    d = x - a * b
    most = np.where(d < 0, np.minimum(a * b, (1 - a) * (1 - b)), np.minimum(a * (1 - b), (1 - a) * b))
    return np.where(most > 1e-12, np.abs(d) / np.maximum(most, 1e-12), 0.0).clip(max=1.0)


def linkage(tables: np.ndarray, steps: int = STEPS, gain: float = GAIN) -> Linkage:
    """EM from independence over all tables at once; a table stops when a step gains less than ``gain``, and its ratio is
    that of the last step. Tables of too few calls get nan."""
    tables = np.asarray(tables, dtype=np.float64).reshape(-1, 9)
    n = tables.sum(axis=1)
    fits = n >= LEAST
    out = Linkage(*[np.full(len(tables), np.nan) for _ in range(3)], np.full((len(tables), 4), np.nan))
    t, n = tables[fits], n[fits]
    if not len(t):
        return out
    apart = independent(t)
    base, p = log_likelihood(t, apart), apart.copy()
    ratio, last = np.zeros(len(t)), np.full(len(t), -np.inf)
    open_ = np.arange(len(t))
    for _ in range(steps):
        ratio[open_] = log_likelihood(t[open_], p[open_]) - base[open_]
        p[open_] = expected_haplotypes(t[open_], p[open_]) / (2 * n[open_, None])
        gained = ratio[open_] >= last[open_] + gain
        last[open_] = ratio[open_]
        open_ = open_[gained]
        if not len(open_):
            break
    chi = 2 * ratio
    out.ratio[fits], out.dprime[fits], out.haplotypes[fits] = chi, d_prime(p), p
    out.z[fits] = np.sqrt(np.maximum(chi, 0)) * np.where(p[:, 0] < apart[:, 0], -1, 1)
    return out


def additive_design() -> np.ndarray:
    """Nine rows of five columns: two for each marker, coded to sum to zero over its genotypes, and a constant."""
    one = np.array([[1, 0], [0, 1], [-1, -1]])
    return np.array([[*one[e], *one[f], 1] for e in range(3) for f in range(3)], dtype=np.float64)


def logistic(case: np.ndarray, control: np.ndarray, design: np.ndarray, steps: int = 25, gain: float = 1e-10) -> np.ndarray:
    """The greatest log likelihood of cases and controls by cell (rows of counts) under a logistic model, by Newton
    steps over all tables at once; a table stops when a step gains less than ``gain``. Steps that lose are halved."""
    n = case + control
    z = np.log((case + 0.5) / (control + 0.5))
    w = n * 0.25
    solve = lambda w, rhs: np.linalg.solve(np.einsum("ci,kc,cj->kij", design, w, design), rhs[..., None])[..., 0]
    beta = solve(w, np.einsum("ci,kc->ki", design, w * z))
    score = lambda b: (lambda eta: (case * eta - n * np.logaddexp(0, eta)).sum(axis=1))(b @ design.T)
    like = score(beta)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(beta @ design.T)))
        move = solve(n * p * (1 - p), np.einsum("ci,kc->ki", design, case - n * p))
        new = score(beta + move)
        for _ in range(20):
            worse = new < like - 1e-12
            if not worse.any():
                break
            move[worse] /= 2
            new = score(beta + move)
        gained, beta, like = new - like, beta + move, np.maximum(like, new)
        if (gained < gain).all():
            break
    return like


def interaction(case: np.ndarray, control: np.ndarray, small: float = 0.1) -> np.ndarray:
    """Twice the gain in log likelihood of a model with a share of cases for each of the nine cells over one in which
    the two markers' effects add up. ``small`` is added to every count."""
    a, b = np.asarray(case, dtype=np.float64).reshape(-1, 9) + small, np.asarray(control, dtype=np.float64).reshape(-1, 9) + small
    if not len(a):
        return np.zeros(0)
    whole = (a * np.log(a / (a + b)) + b * np.log(b / (a + b))).sum(axis=1)
    return 2 * (whole - logistic(a, b, additive_design()))
