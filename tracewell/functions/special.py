"""Distribution functions and exact small-sample p-values, in plain Python."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def student_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else (0.0 if df > 0 else float("nan"))


@lru_cache(maxsize=256)
def _u_counts(n: int, m: int) -> tuple[int, ...]:
    """Number of rank arrangements with each value of U: the Gaussian binomial's coefficients, factor by factor."""
    out = [1] + [0] * (n * m)
    for k in range(1, n + 1):
        for i in range(n * m, m + k - 1, -1):  # times 1 - q^(m + k)
            out[i] -= out[i - m - k]
        for i in range(k, n * m + 1):  # over 1 - q^k
            out[i] += out[i - k]
    return tuple(out)


def mann_whitney_p(u: float, n: int, m: int, ties: float = 0.0) -> float:
    """Two-sided p of U: exact without ties where either side has up to 8, else normal with tie and continuity correction. ties: sum of t^3 - t."""
    if n == 0 or m == 0:
        return float("nan")
    big = max(u, n * m - u)
    if ties == 0 and min(n, m) <= 8:
        counts = _u_counts(min(n, m), max(n, m))
        return min(1.0, 2 * sum(counts[math.ceil(big) :]) / sum(counts))
    total = n + m
    var = n * m / 12 * (total + 1 - ties / (total * (total - 1)))
    return min(1.0, 2 * normal_sf((big - n * m / 2 - 0.5) / math.sqrt(var))) if var > 0 else 1.0


def wilcoxon_p(w: float, n: int, ties: float = 0.0) -> float:
    """Two-sided p of the signed-rank sum w of n non-zero differences: exact up to 50 without ties, else normal with tie correction.
    ties: sum of t^3 - t over equal absolute differences."""
    if n == 0:
        return float("nan")
    low = min(w, n * (n + 1) / 2 - w)
    if not ties and n <= 50:
        counts = [1]
        for k in range(1, n + 1):
            counts = [(counts[i] if i < len(counts) else 0) + (counts[i - k] if i >= k else 0) for i in range(len(counts) + k)]
        return min(1.0, 2 * sum(counts[: math.floor(low) + 1]) / 2**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return min(1.0, 2 * normal_sf((n * (n + 1) / 4 - low) / math.sqrt(var))) if var > 0 else 1.0


#: Samples up to which the two-sample distance has its exact p.
EXACT_KS = 10_000


def kolmogorov_p(d: float, n: int, m: int) -> float:
    """Two-sided p of the two-sample distance d: exact for up to EXACT_KS a side, else asymptotic.

    Exact: of all monotone lattice paths from (0, 0) to (n, m), the share that reaches a distance of d between i / n and j / m. A row of
    path numbers is the running sum of the row before, cut to the band that stays below d; rows are scaled, so that they don't overflow.
    """
    if n == 0 or m == 0:
        return float("nan")
    if max(n, m) > EXACT_KS:
        z = d * math.sqrt(n * m / (n + m))
        return 1.0 if z < 1e-3 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * z) ** 2) for k in range(1, 101))))
    g = math.gcd(n, m)
    steps = n // g * m  # distances are whole multiples of 1 / steps
    reach = round(d * steps)
    if reach <= 0:
        return 1.0
    j = np.arange(m + 1)
    row = np.where(j * (n // g) < reach, 1.0, 0.0)  # i = 0: one path along the edge, while inside
    logs = 0.0
    for i in range(1, n + 1):
        inside = np.abs(i * (m // g) - j * (n // g)) < reach
        row = np.where(inside, np.cumsum(np.where(inside, row, 0.0)), 0.0)
        top = row.max()
        if top == 0:
            return 1.0
        row /= top
        logs += math.log(top)
    if row[m] == 0:
        return 1.0
    total = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1)
    return min(1.0, max(0.0, -math.expm1(logs + math.log(row[m]) - total)))
