"""GARCH(1,1) with zero mean and normal errors, by maximum likelihood without an optimiser library."""

from __future__ import annotations

import numpy as np

SCALE = 100.0


def loglik(r2: np.ndarray, alpha: np.ndarray, beta: np.ndarray, level: np.ndarray, h0: float) -> tuple[np.ndarray, np.ndarray]:
    """Of many parameter triples at once; level is the long-run variance. Also the last variance of each."""
    omega = level * (1 - alpha - beta)
    h, total = np.full(alpha.shape, h0), np.zeros(alpha.shape)
    for x in r2:
        total -= 0.5 * (np.log(h) + x / h)
        h = omega + alpha * x + beta * h
    return total, h


def forecast(returns: np.ndarray, horizon: int) -> tuple[float, bool]:
    """Sum of the next variances and whether the search settled inside the region. Grids narrow around the best point."""
    r2 = (np.asarray(returns, float) * SCALE) ** 2
    var = r2.mean()
    if len(r2) < 50 or not np.isfinite(var) or var <= 0:
        return float("nan"), False
    h0 = float((0.94 ** np.arange(min(75, len(r2))) * r2[: min(75, len(r2))]).sum() / (0.94 ** np.arange(min(75, len(r2)))).sum())
    centre, width = np.array([0.08, 0.90, 0.0]), np.array([0.08, 0.10, 0.5])  # alpha, persistence, log of level over mean
    steps = np.linspace(-1, 1, 7)
    last, moved = -np.inf, np.inf
    for _ in range(12):
        a, s, g = np.meshgrid(*(centre[i] + width[i] * steps for i in range(3)), indexing="ij")
        ok = (a > 1e-4) & (s - a > 0) & (s < 0.9995)
        a, s, g = a[ok], s[ok], g[ok]
        if not len(a):
            return float("nan"), False
        ll, h = loglik(r2, a, s - a, var * np.exp(g), h0)
        i = int(np.argmax(ll))
        edge = np.abs(np.array([a[i], s[i], g[i]]) - centre) > 0.9 * width
        centre = np.array([a[i], s[i], g[i]])
        width = np.where(edge, width, width * 0.4)
        moved, last, h1 = ll[i] - last, ll[i], h[i]
    alpha, persistence, level = centre[0], centre[1], var * np.exp(centre[2])
    k = np.arange(horizon)
    path = level + persistence**k * (h1 - level)
    return float(path.sum() / SCALE**2), bool(abs(moved) < 1e-2 and alpha > 1e-3 and persistence < 0.9990)
