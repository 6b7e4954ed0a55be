"""Small symmetric matrices: conditioning, the semidefinite gate, capped minimum variance."""

from __future__ import annotations

from itertools import product

import numpy as np

REL_TOL, CLIP = 1e-8, 1e-10


def conditions(cov: np.ndarray) -> tuple[float, float]:
    """Condition numbers of a covariance and of its correlations; infinite unless positive definite."""

    def one(m: np.ndarray) -> float:
        e = np.linalg.eigvalsh(m)
        return float(e[-1] / e[0]) if e[0] > 0 else float("inf")

    d = np.sqrt(np.diag(cov))
    return one(cov), one(cov / np.outer(d, d)) if (d > 0).all() else float("inf")


def gate(cov: np.ndarray) -> tuple[np.ndarray, str]:
    """The symmetric matrix and ok, clipped (eigenvalues raised to the floor) or failed (clearly not semidefinite)."""
    m = (cov + cov.T) / 2
    if not np.isfinite(m).all():
        return m, "failed"
    e, v = np.linalg.eigh(m)
    if e[0] < -REL_TOL * max(e[-1], 0.0) or e[-1] <= 0:
        return m, "failed"
    if e[0] < CLIP:
        return (v * np.maximum(e, CLIP)) @ v.T, "clipped"
    return m, "ok"


def min_variance(cov: np.ndarray, cap: float = 1.0) -> np.ndarray | None:
    """Weights from 0 to cap that sum to 1 with least variance, exactly: every choice of bound and free assets is solved, the best
    feasible one kept. For up to about ten assets; None if the caps can't sum to 1."""
    n = len(cov)
    if n * cap < 1 - 1e-12:
        return None
    s = cov / np.trace(cov)
    best, value = None, np.inf
    for state in product((0, 1, 2), repeat=n):  # at 0, at the cap, free
        free = [i for i in range(n) if state[i] == 2]
        w = np.array([cap if x == 1 else 0.0 for x in state])
        left = 1 - w.sum()
        if free:
            k = len(free)
            a = np.zeros((k + 1, k + 1))
            a[:k, :k], a[:k, k], a[k, :k] = s[np.ix_(free, free)], 1.0, 1.0
            fixed = [i for i in range(n) if state[i] == 1]
            rhs = np.append(-s[np.ix_(free, fixed)].sum(axis=1) * cap if fixed else np.zeros(k), left)
            try:
                w[free] = np.linalg.solve(a, rhs)[:k]
            except np.linalg.LinAlgError:
                continue
        elif abs(left) > 1e-12:
            continue
        if w.min() < -1e-10 or w.max() > cap + 1e-10:
            continue
        v = w @ s @ w
        if v < value - 1e-15:
            best, value = w, v
    if best is None:
        return None
    best = np.clip(best, 0, cap)
    return best / best.sum()


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance of the rows shrunk to a multiple of the identity, and the intensity."""
    c = x - x.mean(axis=0)
    n, p = c.shape
    s, f = c.T @ c / n, (c**2).T @ c**2 / n
    mu = np.trace(s) / p
    delta = ((s**2).sum() - p * mu**2) / p
    rho = min((f.sum() - (s**2).sum()) / (p * n), delta) / delta if delta > 0 else 0.0
    return (1 - rho) * s + rho * mu * np.eye(p), float(rho)


def weighted(x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Covariance around the weighted mean, and that mean."""
    mu = weight @ x / weight.sum()
    c = x - mu
    return (c * weight[:, None]).T @ c / weight.sum(), mu


def ahead(now: np.ndarray, transition: np.ndarray, horizon: int) -> np.ndarray:
    """Mean state probability of the next days, for any number of states."""
    if horizon < 1:
        raise ValueError("a horizon has at least one day")
    total = np.zeros_like(now)
    for _ in range(horizon):
        now = now @ transition
        total = total + now
    return total / horizon


def symmetrize(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2


def estimators(x: np.ndarray, gamma: np.ndarray, now: np.ndarray, transition: np.ndarray, fallback: bool, kappa: float = 60.0, between: bool = False, horizon: int = 21, lam: float = 0.94) -> tuple[dict[str, tuple[np.ndarray, dict]], np.ndarray, float]:
    """Each estimator's matrix with its state, effective size and intensity; the mean state probabilities ahead; and the
    relative norm of the spread of the states' means, which joins the mixture only if ``between``. What is consumed is the mixture, or Ledoit-Wolf where the fit falls back."""
    lw, rho = ledoit_wolf(x)
    out: dict[str, tuple[np.ndarray, dict]] = {"sample": (np.cov(x.T), {}), "ewma": (weighted(x, lam ** np.arange(len(x) - 1, -1, -1))[0], {}), "ledoit_wolf": (lw, {"intensity": rho})}
    weight = ahead(now, transition, horizon)
    size = gamma.sum(axis=0) ** 2 / (gamma**2).sum(axis=0)
    within, means = np.zeros_like(lw), []
    for k, w in enumerate(weight):
        raw, mu = weighted(x, gamma[:, k])
        alpha = size[k] / (size[k] + kappa)
        shrunk = alpha * raw + (1 - alpha) * lw
        out[f"state_{k}_raw"] = raw, {"state": k, "n_eff": float(size[k])}
        out[f"state_{k}_shrunk"] = shrunk, {"state": k, "n_eff": float(size[k]), "intensity": float(alpha)}
        within = within + w * shrunk
        means.append(mu)
    means = np.array(means)
    spread = (means - weight @ means).T * weight @ (means - weight @ means)
    norm = float(np.linalg.norm(spread) / np.linalg.norm(within))
    out["regime_mixture"] = symmetrize(within + spread if between else within), {}
    out["consumed"] = out["ledoit_wolf" if fallback else "regime_mixture"][0], {}
    return out, weight, norm
