"""Mixtures and elbows on one-dimensional data, in plain NumPy for grouped tasks."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)
#: Normal quantiles at PERCENTILES.
Z = {p: NormalDist().inv_cdf(p / 100) for p in PERCENTILES}


def _log_density(v: np.ndarray, w, mu, var) -> np.ndarray:
    return np.log(w) - 0.5 * (np.log(2 * math.pi * var) + (v[:, None] - mu) ** 2 / var)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]


def fit_mixture(v: np.ndarray, k: int, seed: int = 0, starts: int = 2, rounds: int = 200, tol: float = 1e-3, floor: float = 1e-6):
    """(weights, means, variances, log-likelihood) of the best of several starts; components by mean.

    Equal values are pooled, so a pass costs the number of distinct values.
    """
    x, n = np.unique(v, return_counts=True)
    total = n.sum()
    best = None
    rng = np.random.default_rng(seed)
    for s in range(starts if k > 1 else 1):
        mu = np.quantile(v, (np.arange(k) + 0.5) / k) if s == 0 else rng.choice(v, k, replace=False)
        for _ in range(20):  # a few rounds of nearest means
            at = np.abs(x[:, None] - mu).argmin(axis=1)
            size = np.bincount(at, weights=n, minlength=k)
            mu = np.where(size > 0, np.bincount(at, weights=n * x, minlength=k) / np.maximum(size, 1), mu)
        resp = np.zeros((len(x), k))
        resp[np.arange(len(x)), np.abs(x[:, None] - mu).argmin(axis=1)] = 1.0
        last = -np.inf
        for _ in range(rounds):
            size = (resp * n[:, None]).sum(axis=0) + 10 * np.finfo(float).eps
            mu = (resp * (n * x)[:, None]).sum(axis=0) / size
            var = (resp * n[:, None] * (x[:, None] - mu) ** 2).sum(axis=0) / size + floor
            w = size / total
            dens = _log_density(x, w, mu, var)
            norm = _log_sum(dens)
            mean = float((norm * n).sum() / total)
            resp = np.exp(dens - norm[:, None])
            if abs(mean - last) < tol:
                break
            last = mean
        if best is None or mean * total > best[3]:
            order = np.argsort(mu, kind="stable")
            best = w[order] / w.sum(), mu[order], var[order], mean * total
    return best


def crossings(w, mu, var, lo: float, hi: float, n: int = 2000) -> list[float]:
    """Linear values where neighbouring components are equally likely, nearest to the middle of their means; that middle without such a place."""
    grid = np.linspace(lo, hi, n)
    dens = _log_density(grid, w, mu, var)
    post = np.exp(dens - _log_sum(dens)[:, None])
    out = []
    for i in range(len(mu) - 1):
        d = post[:, i] - post[:, i + 1]
        flips = np.flatnonzero(np.diff(np.sign(d)) < 0)
        at = mid = 0.5 * (mu[i] + mu[i + 1])
        if len(flips):
            k = flips[np.argmin(np.abs(grid[flips] - mid))]
            at = grid[k] - d[k] * (grid[k + 1] - grid[k]) / (d[k + 1] - d[k])
        out.append(float(10.0**at))
    return out


def largest_drop(curve) -> int:
    """k after the largest fall of the curve over k = 1, 2, ...; never 1 with two values or more."""
    curve = np.asarray(curve, float)
    return int(np.argmin(curve)) + 1 if len(curve) < 2 else int(np.argmin(np.diff(curve))) + 2


def chord_knee(curve, ks=None) -> int:
    """k farthest from the chord between the ends, both axes scaled to 0..1; the least value's k for short or flat curves."""
    y = np.asarray(curve, float)
    ks = np.arange(1, len(y) + 1) if ks is None else np.asarray(ks)
    if len(y) < 3 or ks.max() == ks.min() or y.max() == y.min():
        return int(ks[np.argmin(y)])
    x, y = (ks - ks.min()) / (ks.max() - ks.min()), (y - y.min()) / (y.max() - y.min())
    dx, dy = x[-1] - x[0], y[-1] - y[0]
    return int(ks[np.argmax(np.abs(dx * (y - y[0]) - dy * (x - x[0])))])


def group_picks(picks: list[tuple[str, int | None]]) -> list[dict]:
    """[{k, methods}] of the picks by ascending k, methods in the order given."""
    return [{"k": k, "methods": [m for m, v in picks if v == k]} for k in sorted({v for _, v in picks if v is not None})]


def fit_channel(values, k_max: int = 6, drop_zeros: bool = True, seed: int = 0, jitter: bool = True, tail_weight: float = 0.15) -> dict:
    """Mixtures of 1..k_max components on log10 counts, with scores, cuts, picks and a warning about a rare high component."""
    v = np.asarray(values, float)
    n = len(v)
    zeros = float((v <= 0).sum() if drop_zeros else (v == 0).sum()) / n if n else 0.0
    v = v[v > 0] if drop_zeros else v + 0.5
    quantiles = {p: float(np.percentile(v, p)) if len(v) else 0.0 for p in PERCENTILES}
    out = {"frac_zeros": zeros, "frac_used": len(v) / n if n else 0.0, "n_used": len(v), "quantiles": quantiles, "fits": [], "best_k_bic": None, "best_k_aic": None, "largest_drop_k": None, "kneedle_k": None, "sensible_k": None, "agree": None, "recommendations": [], "tail_warning": None}
    if len(v) < 50:
        return out
    if jitter:
        v = np.maximum(v + np.random.default_rng(seed).uniform(-0.5, 0.5, len(v)), 1e-3)
    log = np.log10(v)
    for k in range(1, k_max + 1):
        w, mu, var, likelihood = fit_mixture(log, k, seed)
        params = 3 * k - 1
        parts = [{"weight": float(w[i]), "mean_log10": float(mu[i]), "std_log10": float(math.sqrt(var[i])), "mean_counts": float(10 ** mu[i]), "quantiles": {p: float(10 ** (mu[i] + math.sqrt(var[i]) * z)) for p, z in Z.items()}} for i in range(k)]
        out["fits"].append({"k": k, "bic": params * math.log(len(log)) - 2 * likelihood, "aic": 2 * params - 2 * likelihood, "components": parts, "thresholds": crossings(w, mu, var, log.min(), log.max()) if k > 1 else []})
    bic = [f["bic"] for f in out["fits"]]
    drop, knee, best = largest_drop(bic), chord_knee(bic), int(np.argmin(bic)) + 1
    out |= {"best_k_bic": best, "best_k_aic": int(np.argmin([f["aic"] for f in out["fits"]])) + 1, "largest_drop_k": drop, "kneedle_k": knee, "sensible_k": min(drop, knee), "agree": drop == knee, "recommendations": group_picks([("bic", best), ("largest_drop", drop), ("kneedle", knee)])}
    out["tail_warning"] = tail_warning(out["fits"], out["sensible_k"], k_max, tail_weight)
    return out


def tail_warning(fits: list[dict], k: int, k_max: int, tail_weight: float) -> dict | None:
    """The top component that k + 1 would add, if it is rarer than tail_weight and above all of k's."""
    if k >= k_max:
        return None
    top = fits[k]["components"][-1]
    if top["mean_counts"] > max(c["mean_counts"] for c in fits[k - 1]["components"]) and top["weight"] <= tail_weight:
        return {"suggested_k": k + 1, "weight": top["weight"], "mean_counts": top["mean_counts"], **{f"p{p}": top["quantiles"][p] for p in (5, 50, 95)}}
    return None
