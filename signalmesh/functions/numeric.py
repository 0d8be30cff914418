"""Small-array numerics of the driver and of Arrow functions: ranks, HAC inference, quantiles."""

from __future__ import annotations

import math

import numpy as np


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Column-wise average ranks, starting at 1."""
    x = np.asarray(x, float)
    flat = x.ndim == 1
    x = x[:, None] if flat else x
    n = len(x)
    order = np.argsort(x, axis=0, kind="stable")
    s = np.take_along_axis(x, order, 0)
    place = np.broadcast_to(np.arange(n)[:, None], x.shape)
    new = np.ones(x.shape, bool)
    new[1:] = s[1:] != s[:-1]
    first = np.maximum.accumulate(np.where(new, place, 0), 0)
    ends = np.ones(x.shape, bool)
    ends[:-1] = new[1:]
    last = np.minimum.accumulate(np.where(ends, place, n)[::-1], 0)[::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, 0)
    return out[:, 0] if flat else out


def pearson(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation, NaN where a side is constant."""
    a, b = a - a.mean(), b - b.mean()
    scale = math.sqrt(float(a @ a) * float(b @ b))
    return float(a @ b) / scale if scale > 0 else math.nan


def rank_ic(signals: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rank correlation of each signal column with the target, NaN where undefined."""
    r, t = average_ranks(signals), average_ranks(target)
    r, t = r - r.mean(0), t - t.mean()
    scale = np.sqrt((r * r).sum(0) * float(t @ t))
    return np.divide(t @ r, scale, out=np.full(r.shape[1], np.nan), where=scale > 0)


def hac_variance(x: np.ndarray, lags: int = 25) -> float:
    """Long-run variance with Bartlett weights over the defined values, which close up."""
    x = np.asarray(x, float)
    x = x[~np.isnan(x)]
    n = len(x)
    if not n:
        return math.nan
    d = x - x.mean()
    cov = [float(d[: n - j] @ d[j:]) / n for j in range(min(lags, n - 1) + 1)]
    return max(cov[0] + 2 * sum((1 - j / (lags + 1.0)) * c for j, c in enumerate(cov) if j), 1e-18)


def newey_west(x: np.ndarray, lags: int = 25) -> tuple[float, float]:
    x = np.asarray(x, float)
    x = x[~np.isnan(x)]
    if len(x) < 2:
        return math.nan, math.nan
    return float(x.mean()), float(x.mean() / math.sqrt(hac_variance(x, lags) / len(x)))


def hac_se(x: np.ndarray, lags: int = 25) -> float:
    n = int((~np.isnan(np.asarray(x, float))).sum())
    return math.sqrt(hac_variance(x, lags) / n) if n else math.nan


def nanmean(x: np.ndarray, empty: float = math.nan) -> float:
    x = np.asarray(x, float)
    x = x[~np.isnan(x)]
    return float(x.mean()) if len(x) else empty


def unit(w: np.ndarray) -> np.ndarray:
    w = np.asarray(w, float)
    n = float(np.linalg.norm(w))
    return w / n if n > 0 else w


def signs(x: np.ndarray) -> np.ndarray:
    """+1 where not negative, else (also undefined) -1."""
    return np.where(np.asarray(x, float) >= 0, 1.0, -1.0)


def normal_sf2(t: float) -> float:
    """Two-sided p-value of a standard normal."""
    return math.erfc(abs(t) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated from the front."""
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 400):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + up * d) or tiny)
            c = (1 + up / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def t_cdf(t: float, df: float) -> float:
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    tail = front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b
    return 1 - tail / 2 if t > 0 else tail / 2


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t for p above one half, by bisection."""
    lo, hi = 0.0, 1.0
    while t_cdf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2
