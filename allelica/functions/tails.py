"""Tail probabilities without SciPy: normal, chi-square, F, Student, by series and continued fractions."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt


def normal_tail(z: float) -> float:
    return 0.5 * erfc(z / sqrt(2))


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    if x <= 0:
        return 1.0
    front = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi_square_tail(x: float, dof: float) -> float:
    return 1.0 if dof <= 0 else gamma_tail(dof / 2, x / 2)


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 500):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + n * d or 1e-300)
            c = 1 + n / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def student_tail(t: float, dof: float) -> float:
    share = 0.5 * beta_share(dof / 2, 0.5, dof / (dof + t * t))
    return share if t > 0 else 1 - share
