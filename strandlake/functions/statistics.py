"""Statistics of ungapped scores: lambda, K and H of a score distribution, target frequencies, and sums of linked hits."""

from __future__ import annotations

from functools import lru_cache
from math import gcd, lgamma

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Steps of the sum over random walks for K, and its tail below which it ends.
WALKS, TAIL = 300, 1e-9


def lambda_of(scores: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Positive root of sum p exp(x score) = 1 of each row of ``p``; NaN where the mean isn't below 0 or no score above 0 can occur."""
    p = np.atleast_2d(np.asarray(p, np.float64))
    s = np.asarray(scores, np.float64)
    able = (p @ s < 0) & ((p * (s > 0)).sum(1) > 0)
    f = lambda x: (p * np.exp(np.outer(x, s))).sum(1) - 1
    low, high = np.zeros(len(p)), np.full(len(p), 0.5)
    for _ in range(60):
        small = able & (f(high) < 0)
        if not small.any():
            break
        high = np.where(small, 2 * high, high)
    # Newton from the right of the root, where the function is convex and rises; a step that leaves the bracket is halved
    x = high.copy()
    for _ in range(200):
        e = p * np.exp(np.outer(x, s))
        v, slope = e.sum(1) - 1, (e * s).sum(1)
        low, high = np.where(v < 0, x, low), np.where(v < 0, high, x)
        step = np.where(slope > 0, x - v / np.where(slope > 0, slope, 1), (low + high) / 2)
        new = np.where((step > low) & (step < high), step, (low + high) / 2)
        done = np.abs(new - x) <= 1e-14 * x
        x = new
        if (done | ~able).all():
            break
    return np.where(able, x, np.nan)


def karlin(scores: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lambda, K, H) of each row of ``p``, the chances of the whole ``scores``; NaN where there is no lambda."""
    p, s = np.atleast_2d(np.asarray(p, np.float64)), np.asarray(scores, np.int64)
    lam = lambda_of(s, p)
    h = np.where(np.isnan(lam), np.nan, lam * (p * s * np.exp(np.outer(np.nan_to_num(lam), s))).sum(1))
    k = np.full(len(p), np.nan)
    low, high = int(s.min()), int(s.max())
    for r in np.flatnonzero(~np.isnan(lam)).tolist():
        span = 0
        for v, chance in zip(s.tolist(), p[r].tolist()):
            if chance > 0:
                span = gcd(span, abs(v))
        step = np.zeros(high - low + 1)
        np.add.at(step, s - low, p[r])
        walk, total = np.ones(1), 0.0
        for n in range(1, WALKS + 1):
            walk = np.convolve(walk, step)
            at = np.arange(len(walk)) + n * low
            term = (walk * np.exp(np.minimum(at, 0) * lam[r])).sum() / n
            total += term
            if term < TAIL:
                break
        k[r] = span * lam[r] * np.exp(-2 * total) / (h[r] * (1 - np.exp(-span * lam[r])))
    return lam, k, h


def target_frequencies(q: np.ndarray, rows: np.ndarray, cols: np.ndarray, entropy: float | None = None) -> np.ndarray:
    """The frequencies nearest to ``q`` (least relative entropy) with these row and column sums, by Newton's method on the dual.

    With ``entropy``, that much relative entropy to the product of the sums is asked for as well; its multiplier is found by bisection.
    """
    q, rows, cols = (np.asarray(v, np.float64) for v in (q, rows, cols))
    rows, cols = rows / rows.sum(), cols / cols.sum()
    product = np.outer(rows, cols)

    def fitted(log_base: np.ndarray) -> np.ndarray:
        n, m = log_base.shape
        x = np.zeros(n + m - 1)  # the last column's multiplier is 0
        goal = np.concatenate((rows, cols[:-1]))

        def at(v: np.ndarray) -> np.ndarray:
            return np.exp(np.clip(log_base + v[:n, None] + np.append(v[n:], 0.0)[None, :], -700, 700))

        dual = lambda v: at(v).sum() - v @ goal  # noqa: E731  convex; its gradient is what the sums miss
        for _ in range(200):
            x_now = at(x)
            grad = np.concatenate((x_now.sum(1), x_now.sum(0)[:-1])) - goal
            if np.abs(grad).max() < 1e-13:
                break
            hess = np.zeros((n + m - 1, n + m - 1))
            hess[np.arange(n), np.arange(n)] = x_now.sum(1)
            hess[np.arange(n, n + m - 1), np.arange(n, n + m - 1)] = x_now.sum(0)[:-1]
            hess[:n, n:], hess[n:, :n] = x_now[:, :-1], x_now[:, :-1].T
            way, size, here = np.linalg.solve(hess + 1e-15 * np.eye(len(x)), grad), 1.0, dual(x)
            while size > 1e-10 and not dual(x - size * way) <= here - 1e-4 * size * (grad @ way) + 1e-16:
                size /= 2
            x = x - size * way
        return at(x)

    if entropy is None:
        return fitted(np.log(q))
    told = lambda x: float((x * np.log(x / product)).sum())
    lean = lambda t: fitted(np.log(q) * t + np.log(product) * (1 - t))  # noqa: E731  t = 0: the product, with entropy 0
    low, high = 0.0, 1.0
    while told(lean(high)) < entropy and high < 64:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if told(lean(mid)) < entropy else (low, mid)
        if high - low < 1e-12 * high:
            break
    return lean((low + high) / 2)


def _gamma_below(r: int, z: np.ndarray) -> np.ndarray:
    """Chance that a gamma variate of shape r is at most z, by its series; 1 far above r."""
    z = np.minimum(z, r + 12 * np.sqrt(r) + 60)
    term = np.exp(r * np.log(np.maximum(z, 1e-300)) - z - lgamma(r + 1))
    total = term.copy()
    for k in range(r + 1, r + 2000):
        term = term * z / k
        total += term
        if (term <= 1e-16 * total).all():
            break
    return np.minimum(total, 1.0)


@lru_cache(maxsize=65536)
def sum_tail(r: int, s: float) -> float:
    """Chance that the sum of the r best normalised scores is s or more (Karlin and Altschul 1993).

    The r-th best is -ln of a gamma variate of shape r, and what the better ones have above it is another of shape r - 1, so one
    integral over the latter is left.
    """
    if s < -60 * r:
        return 1.0
    if r == 1:
        return float(-np.expm1(-np.exp(-s)))
    g = np.linspace(0, max(s, 0) + r + 12 * np.sqrt(r) + 60, 4001)
    density = np.exp((r - 2) * np.log(np.maximum(g, 1e-300)) - g - lgamma(r - 1))
    return float(min(1.0, np.trapezoid(density * _gamma_below(r, np.exp(np.minimum((g - s) / r, 50.0))), g)))


def linked_expect(r: int, total: float, space: float, link: float, decay: float = 0.5) -> float:
    """Chains expected by chance: ``total`` is lambda times the summed scores, ``space`` is K m n, ``link`` the price of each link (ln K + 2 ln gap).

    The sum is normalised by the space, the links and the r! orders that collinearity rules out; the chance is then divided by
    the share (1 - decay) decay^(r-1) of all tries that r links have.
    """
    norm = total - np.log(space) - (r - 1) * link - lgamma(r + 1)
    chance = sum_tail(r, round(float(norm), 3)) / ((1 - decay) * decay ** (r - 1))
    return float(-np.log1p(-chance)) if chance < 1 else float("inf")


def karlin_columns(scores: list[int]):
    """Column function (chances of the scores, an array) -> struct of lambda, k and h."""

    @F.pandas_udf("struct<lambda:double,k:double,h:double>")
    def run(p: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("lambda", "k", "h"), karlin(np.array(scores), np.array(p.tolist()).reshape(len(p), -1)))))

    return run


def target_columns(base: list[list[float]], entropy: float | None = None):
    """Column function (row sums, column sums) -> target frequencies nearest to ``base``, row by row in one array."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series, cols: pd.Series) -> pd.Series:
        return pd.Series([target_frequencies(base, r, c, entropy).ravel() for r, c in zip(rows, cols)])

    return run
