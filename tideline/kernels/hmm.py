"""Gaussian hidden Markov models with full covariances, many starts at once.

All starts of a fit share one pass over time: arrays carry a leading axis of starts, so a step
costs about the same for sixteen starts as for one.
"""

from __future__ import annotations

import numpy as np

MIN_COVAR = 1e-3


def standardize(x: np.ndarray) -> np.ndarray:
    """Columns to mean 0 and sample deviation 1; a constant column is only centred."""
    sd = x.std(axis=0, ddof=1)
    return (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1.0)


def log_density(x: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """(starts, T, K) log densities."""
    d = x.shape[1]
    chol = np.linalg.cholesky(cov)
    diff = x[None, None] - mu[:, :, None]
    z = np.linalg.solve(chol, np.swapaxes(diff, 2, 3))
    half = np.log(np.diagonal(chol, axis1=2, axis2=3)).sum(axis=2)
    return np.swapaxes(-0.5 * (z**2).sum(axis=2) - half[:, :, None] - 0.5 * d * np.log(2 * np.pi), 1, 2)


def _through(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """a @ p on the last axis, for the few states of a model."""
    out = a[..., 0, None] * p[..., 0, :]
    for i in range(1, p.shape[-1]):
        out += a[..., i, None] * p[..., i, :]
    return out


def forward_backward(logb: np.ndarray, pi: np.ndarray, p: np.ndarray):
    """Scaled recursions: filtered and smoothed posteriors, expected transitions, log-likelihoods.

    Time is cut into about sqrt(T) blocks that step side by side: a product of transitions and densities carries a block's
    start to its end, so that about sqrt(T) steps of each recursion do the work of T. Steps added at the end have density 1."""
    s, t_max, k = logb.shape
    top = logb.max(axis=2)
    length = max(1, int(np.ceil(np.sqrt(t_max))))
    n = -(-t_max // length)
    b = np.ones((n * length, s, k))
    b[:t_max] = np.swapaxes(np.exp(logb - top[:, :, None]), 0, 1)
    b = np.ascontiguousarray(b.reshape(n, length, s, k).swapaxes(0, 1))  # (step, block, start, state)
    first = np.repeat(p[None], n, axis=0)
    first[0] = pi[:, None, :]  # whatever comes before the series, its first state is drawn from pi
    carry = _through(np.repeat(np.eye(k)[None, None], s, axis=1), first[:, :, None]) * b[0][:, :, None]
    for i in range(1, length):
        carry = _through(carry, p[:, None]) * b[i][:, :, None]
        carry /= carry.sum(axis=(2, 3), keepdims=True)
    before, after = np.empty((n, s, k)), np.empty((n, s, k))
    a = np.full((s, k), 1 / k)
    for j in range(n):
        before[j] = a
        a = _through(a, carry[j])
        a /= a.sum(axis=1, keepdims=True)
    z = np.ones((s, k))
    for j in range(n - 1, -1, -1):
        after[j] = z
        z = (carry[j] * z[:, None]).sum(axis=2)
        z /= z.sum(axis=1, keepdims=True)
    alpha, beta, scale = np.empty_like(b), np.empty_like(b), np.empty((length, n, s))
    a = before
    for i in range(length):
        a = _through(a, p if i else first) * b[i]
        scale[i] = a.sum(axis=2)
        a /= scale[i][:, :, None]
        alpha[i] = a
    back, z = np.swapaxes(p, 1, 2), after
    for i in range(length - 1, -1, -1):
        beta[i] = z
        z = _through(b[i] * z, back)
        z /= z.sum(axis=2, keepdims=True)
    alpha, beta, b, scale = (x.swapaxes(0, 1).reshape(n * length, *x.shape[2:])[:t_max] for x in (alpha, beta, b, scale))
    gamma = alpha * beta
    mass = gamma.sum(axis=2, keepdims=True)
    xi = np.einsum("tsi,tsj->sij", alpha[:-1], (b * beta / (mass * scale[:, :, None]))[1:])
    loglik = np.log(scale).sum(axis=0) + top.sum(axis=1)
    return np.swapaxes(alpha, 0, 1), np.swapaxes(gamma / mass, 0, 1), xi * p, loglik


def start(x: np.ndarray, k: int, seed: int):
    """Means by a few rounds of k-means from seeded points; uniform chain; pooled covariance."""
    rng = np.random.default_rng(seed)
    mu = x[rng.choice(len(x), k, replace=False)]
    for _ in range(10):
        own = ((x[:, None] - mu[None]) ** 2).sum(axis=2).argmin(axis=1)
        mu = np.stack([x[own == j].mean(axis=0) if (own == j).any() else mu[j] for j in range(k)])
    cov = np.cov(x.T).reshape(x.shape[1], x.shape[1]) + MIN_COVAR * np.eye(x.shape[1])
    return mu, np.repeat(cov[None], k, axis=0)


def fit(x: np.ndarray, k: int, seeds: list[int], n_iter: int = 200, tol: float = 1e-4) -> list[dict]:
    """One result for each seed: parameters, log-likelihood, converged, iterations. Starts that have converged leave the pass."""
    d = x.shape[1]
    mu, cov = (np.stack(v) for v in zip(*(start(x, k, s) for s in seeds), strict=True))
    pi, p = np.full((len(seeds), k), 1 / k), np.full((len(seeds), k, k), 1 / k)
    out: list[dict | None] = [None] * len(seeds)
    active, last = np.arange(len(seeds)), np.full(len(seeds), -np.inf)
    for it in range(1, n_iter + 1):
        logb = log_density(x, mu[active], cov[active])
        _, gamma, xi, ll = forward_backward(logb, pi[active], p[active])
        done = (np.abs(ll - last[active]) < tol) | ~np.isfinite(ll)
        for i in np.flatnonzero(done | (it == n_iter)):
            j = active[i]
            out[j] = {"seed": seeds[j], "loglik": float(ll[i]), "converged": bool(done[i] and np.isfinite(ll[i])), "n_iter": it, "pi": pi[j].copy(), "p": p[j].copy(), "mu": mu[j].copy(), "cov": cov[j].copy()}
        last[active] = ll
        keep = ~done
        if not keep.any() or it == n_iter:
            break
        active, gamma, xi = active[keep], gamma[keep], xi[keep]
        w = np.maximum(gamma.sum(axis=1), 1e-12)
        pi[active] = gamma[:, 0]
        p[active] = np.maximum(xi, 1e-300) / np.maximum(xi, 1e-300).sum(axis=2, keepdims=True)
        m = np.einsum("stk,td->skd", gamma, x) / w[:, :, None]
        second = np.einsum("stk,td,te->skde", gamma, x, x, optimize=True) / w[:, :, None, None]
        mu[active] = m
        c = second - m[:, :, :, None] * m[:, :, None, :]
        cov[active] = (c + np.swapaxes(c, 2, 3)) / 2 + MIN_COVAR * np.eye(d)
    return out


def select(results: list[dict], rel: float = 1e-10) -> dict | None:
    """The lowest seed among usable starts whose likelihood is the best up to rel * max(1, abs(best))."""
    usable = [r for r in results if r and r["converged"] and np.isfinite(r["loglik"])]
    if not usable:
        return None
    best = max(r["loglik"] for r in usable)
    return min((r for r in usable if r["loglik"] >= best - rel * max(1.0, abs(best))), key=lambda r: r["seed"])


def permute(model: dict, order: np.ndarray) -> dict:
    return model | {"pi": model["pi"][order], "p": model["p"][np.ix_(order, order)], "mu": model["mu"][order], "cov": model["cov"][order]}


def posteriors(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered and smoothed probabilities (T, K); their last rows agree."""
    f, g, _, _ = forward_backward(log_density(x, model["mu"][None], model["cov"][None]), model["pi"][None], model["p"][None])
    return f[0], g[0]


def diagnose(model: dict, gamma: np.ndarray, least_share: float = 0.05, least_eig: float = 1e-8) -> dict:
    """Occupancy, effective size, persistence, duration and the flags that route a fit to its fallback."""
    stay = np.diagonal(model["p"])
    occupancy = gamma.mean(axis=0)
    eig = np.array([np.linalg.eigvalsh(c)[0] for c in model["cov"]])
    absorbing, thin, singular = bool((stay > 1 - 1e-6).any()), bool((occupancy < least_share).any()), bool((eig < least_eig).any())
    with np.errstate(divide="ignore"):
        duration = np.where(stay < 1, 1 / np.maximum(1 - stay, 1e-300), np.inf)
    reasons = [name for name, on in (("absorbing_state", absorbing), ("degenerate_occupancy", thin), ("singular_covariance", singular)) if on]
    return {"occupancy": occupancy.tolist(), "n_eff": (gamma.sum(axis=0) ** 2 / np.maximum((gamma**2).sum(axis=0), 1e-300)).tolist(), "persistence": stay.tolist(), "duration": duration.tolist(), "min_eigenvalue": eig.tolist(), "fallback_used": bool(reasons), "fallback_reason": ";".join(reasons), "guard_triggered": bool(reasons) or bool((np.abs(model["p"].sum(axis=1) - 1) > 1e-6).any())}
