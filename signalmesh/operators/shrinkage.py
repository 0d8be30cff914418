"""Random-effects pooling of a handful of effects: between-variance estimators, shrinkage, intervals."""

from __future__ import annotations

import math

import numpy as np

from ..functions.numeric import signs, t_quantile


def _pool(e: np.ndarray, s: np.ndarray, tau2: float) -> tuple[np.ndarray, float, float]:
    """(weights, pooled mean, heterogeneity statistic) at a between-variance."""
    w = 1 / (s * s + tau2)
    mu = float(w @ e / w.sum())
    return w, mu, float(w @ (e - mu) ** 2)


def tau2_dl(effects, ses) -> float:
    """Method of moments; never negative."""
    e, s = np.asarray(effects, float), np.asarray(ses, float)
    w, _, q = _pool(e, s, 0.0)
    scale = float(w.sum() - (w @ w) / w.sum())
    return max(0.0, (q - len(e) + 1) / scale) if scale > 0 else 0.0


def tau2_pm(effects, ses, steps: int = 200) -> float:
    """The between-variance at which the heterogeneity statistic equals its degrees of freedom, by bisection."""
    e, s = np.asarray(effects, float), np.asarray(ses, float)
    e, s = e[np.isfinite(s)], s[np.isfinite(s)]
    df = len(e) - 1
    if df < 1 or _pool(e, s, 0.0)[2] <= df:
        return 0.0
    lo, hi = 0.0, 10 * float(np.var(e, ddof=1)) + 10 * float(s.max()) ** 2 + 1e-8
    while steps and hi - lo >= 1e-12:
        mid, steps = (lo + hi) / 2, steps - 1
        if _pool(e, s, mid)[2] > df:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def tau2_reml(effects, ses, steps: int = 500) -> float:
    """Restricted maximum likelihood by fixed point, from the excess variance; effects of infinite error have no part."""
    e, s = np.asarray(effects, float), np.asarray(ses, float)
    e, s = e[np.isfinite(s)], s[np.isfinite(s)]
    if len(e) < 2:
        return 0.0
    now = max(1e-10, float(np.var(e, ddof=1) - np.mean(s * s)))
    for _ in range(steps):
        w, mu, _ = _pool(e, s, now)
        ww = w * w
        new = max(0.0, float((ww @ ((e - mu) ** 2 - s * s) + ww.sum() / w.sum() * now) / ww.sum()))
        if abs(new - now) < 1e-12:
            return new
        now = new
    return now


def shrink_with_tau2(effects, ses, tau2: float) -> np.ndarray:
    """Each effect drawn to the pooled mean by its share of sampling variance."""
    e, s = np.asarray(effects, float), np.asarray(ses, float)
    _, mu, _ = _pool(e, s, tau2)
    return mu + tau2 / (tau2 + s * s) * (e - mu)


def dl_shrink(effects, ses) -> tuple[np.ndarray, float]:
    tau2 = tau2_dl(effects, ses)
    return shrink_with_tau2(effects, ses, tau2), tau2


def hartung_knapp_interval(effects, ses, tau2: float, level: float = 0.95) -> tuple[float, float, float]:
    """(pooled, low, high); undefined bounds for fewer than two effects."""
    e, s = np.asarray(effects, float), np.asarray(ses, float)
    w, mu, q = _pool(e, s, tau2)
    if len(e) < 2:
        return mu, math.nan, math.nan
    half = t_quantile((1 + level) / 2, len(e) - 1) * math.sqrt(q / (len(e) - 1) / w.sum())
    return mu, mu - half, mu + half


def equal_block_weights(block_ic) -> np.ndarray:
    """The signs; a single block always has +1."""
    return signs(block_ic) if len(block_ic) > 1 else np.ones(1)


def adaptive_block_weights(block_ic, block_se) -> tuple[np.ndarray, float]:
    """Shrunk magnitudes with the signs put back, and the between-variance."""
    s = signs(block_ic)
    shrunk, tau2 = dl_shrink(s * np.asarray(block_ic, float), block_se)
    return s * shrunk, tau2
