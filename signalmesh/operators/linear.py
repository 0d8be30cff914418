"""Linear composition: every method maps (panel, training days) to a weight vector on the raw features.

A standardised signal Z w equals X (w / sd) up to a constant, which ranks ignore; so vectors are all that is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

import numpy as np

from ..functions.numeric import hac_se, nanmean, signs, unit
from .shrinkage import dl_shrink

#: Grids of the tuned methods (fixed values).
RIDGE = UNIQUENESS = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)
LASSO = (0.5, 0.3, 0.2, 0.1, 0.05, 0.02)
SHRINK = tuple((g, lam) for g in (0.0, 0.5, 1.0, 2.0) for lam in (0.1, 0.5, 1.0, 4.0, 16.0))
PLS_MAX = 8


def tuned(panel, days: np.ndarray, grid: Sequence, fit: Callable) -> tuple[np.ndarray, object]:
    """Refit at the grid value whose inner fit scores best on the inner validation days; all candidates in one job."""
    inner, validation = panel.inner_split(days)
    best = grid[panel.best([fit(panel, inner, g) for g in grid], validation)]
    return fit(panel, days, best), best


def naive_averaged(panel, days):
    return signs(panel.mean_ic(days)) / panel.p


def ic_weight(panel, days):
    return unit(panel.mean_ic(days)) / panel.moments(days).sd()


def pca_pc1(panel, days):
    m = panel.moments(days)
    v = np.linalg.eigh(m.correlation())[1][:, -1] / m.sd()
    towards = v @ m.co[: panel.p, : panel.p] @ naive_averaged(panel, days)
    return -v if towards < 0 else v


def uniqueness_reg(panel, days, lam: float = 1.0):
    m = panel.moments(days)
    return unit(np.linalg.solve(m.correlation() + lam * np.eye(panel.p), panel.mean_ic(days))) / m.sd()


def uniqueness_tuned(panel, days):
    return tuned(panel, days, UNIQUENESS, uniqueness_reg)[0]


def feature_effects(panel, days) -> tuple[np.ndarray, np.ndarray]:
    """(mean ICs, their HAC standard errors) of the features."""
    f = panel.feature_ic[days]
    return panel.mean_ic(days), np.array([hac_se(f[:, j]) for j in range(panel.p)])


def eb_weight(panel, days):
    ic, se = feature_effects(panel, days)
    s = signs(ic)
    return unit(s * dl_shrink(s * ic, se)[0]) / panel.moments(days).sd()


def shrink_weights(ic: np.ndarray, corr: np.ndarray, gamma: float, lam: float) -> np.ndarray:
    """Mean-variance weights drawn to the equal-weight portfolio."""
    p = len(ic)
    pull = ic / np.abs(ic).mean() + lam * signs(ic) / p
    return unit(np.linalg.solve(gamma * corr + lam * np.eye(p), pull))


def shrink_to_naive(panel, days):
    def fit(panel, days, g):
        m = panel.moments(days)
        return shrink_weights(panel.mean_ic(days), m.correlation(), *g) / m.sd()

    return tuned(panel, days, SHRINK, fit)[0]


def ols(panel, days):
    """Least squares by the pseudo-inverse, as near-duplicates make the normal equations singular."""
    m = panel.moments(days)
    c, g = m.standardised()
    return np.linalg.pinv(c, rcond=1e-10, hermitian=True) @ g / m.sd()


def ridge(panel, days, lam: float):
    m = panel.moments(days)
    c, g = m.standardised()
    return np.linalg.solve(c + lam * np.eye(panel.p), g) / m.sd()


def ridge_tuned(panel, days):
    return tuned(panel, days, RIDGE, ridge)[0]


def lasso_path_point(c: np.ndarray, g: np.ndarray, frac: float, sweeps: int = 300, tol: float = 1e-7) -> np.ndarray:
    """Coordinate descent on the Gram matrix at a fraction of the smallest penalty that zeroes everything."""
    lam, w, diag = frac * float(np.abs(g).max()), np.zeros(len(g)), np.diag(c)
    left = np.array(g, float)  # g - c w
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(g)):
            pull = left[j] + diag[j] * w[j]
            new = np.sign(pull) * max(abs(pull) - lam, 0.0) / diag[j]
            if new != w[j]:
                left -= c[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]))
                w[j] = new
        if moved < tol:
            break
    return w


def lasso(panel, days, frac: float, rank_target: bool = False):
    m = panel.moments(days)
    return lasso_path_point(*m.standardised(rank_target), frac) / m.sd()


def lasso_tuned(panel, days):
    return tuned(panel, days, LASSO, lasso)[0]


def lasso_uniqueness(panel, days):
    return tuned(panel, days, LASSO, partial(lasso, rank_target=True))[0]


def pls_coefficients(c: np.ndarray, g: np.ndarray, k: int) -> np.ndarray:
    """PLS1 by deflating the moments: each component takes t t' p p' off Z'Z and its share off Z'y."""
    c, g, ws, ps, qs = c.copy(), g.copy(), [], [], []
    for _ in range(k):
        size = float(np.linalg.norm(g))
        if size < 1e-14:
            break
        w = g / size
        tt = float(w @ c @ w)
        if tt < 1e-14:
            break
        p, q = c @ w / tt, float(g @ w) / tt
        c, g = c - tt * np.outer(p, p), g - q * tt * p
        ws.append(w), ps.append(p), qs.append(q)
    if not ws:
        return np.zeros(len(g))
    w, p = np.array(ws).T, np.array(ps).T
    return w @ np.linalg.lstsq(p.T @ w, np.array(qs), rcond=None)[0]


def pls(panel, days, k: int):
    m = panel.moments(days)
    return pls_coefficients(*m.standardised(), k) / m.sd()


def pls_grid(panel) -> range:
    return range(1, min(PLS_MAX, panel.p) + 1)


def pls_components(k: int) -> Callable:
    return lambda panel, days: pls(panel, days, k)


def pls_tuned(panel, days):
    return tuned(panel, days, pls_grid(panel), pls)[0]


def pls_sweep(panel) -> dict[str, list]:
    """Out-of-fold mean IC by number of components: all counts and folds in one job."""
    folds, grid = list(panel.folds()), list(pls_grid(panel))
    ics = panel.ic_of(np.array([pls(panel, train, k) for k in grid for _, train, _ in folds]))
    each = np.array([[nanmean(ics[test, i * len(folds) + f]) for f, _, test in folds] for i in range(len(grid))])
    return {"k": grid, "mean": each.mean(1).tolist(), "std": (each.std(1, ddof=1) if len(folds) > 1 else np.full(len(grid), np.nan)).tolist()}


METHODS: dict[str, Callable] = {f.__name__: f for f in (naive_averaged, ic_weight, pca_pc1, uniqueness_reg, uniqueness_tuned, eb_weight, shrink_to_naive, ols, ridge_tuned, lasso_tuned, pls_tuned, lasso_uniqueness)}
