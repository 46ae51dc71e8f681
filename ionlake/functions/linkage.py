"""Agglomerative linkage and cluster scores on a bounded sample, in NumPy."""

from __future__ import annotations

import numpy as np

METHODS = ("ward", "single", "complete", "average", "centroid")


def distances(x: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a bounded sample."""
    sq = (x * x).sum(axis=1)
    return np.sqrt(np.maximum(sq[:, None] + sq - 2 * x @ x.T, 0.0))


def linkage(x: np.ndarray, method: str = "ward") -> np.ndarray:
    """Merges (a, b, height, size) by ascending height order of joining; new clusters are numbered from n.

    The nearest pair is joined each time and the distances to the rest are
    updated by the method's recurrence; nearest neighbours are kept by row.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    n = len(x)
    d = distances(x)
    if method in ("ward", "centroid"):
        d = d * d
    np.fill_diagonal(d, np.inf)
    size, name, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    near = d.argmin(axis=1) if n > 1 else np.zeros(n, int)
    gap = d[np.arange(n), near]
    out = np.zeros((max(n - 1, 0), 4))
    for t in range(n - 1):
        a = int(np.argmin(np.where(alive, gap, np.inf)))
        b = int(near[a])
        h, na, nb = d[a, b], size[a], size[b]
        rest = alive.copy()
        rest[[a, b]] = False
        da, db, nk = d[a, rest], d[b, rest], size[rest]
        if method == "ward":
            new = ((na + nk) * da + (nb + nk) * db - nk * h) / (na + nb + nk)
        elif method == "centroid":
            new = (na * da + nb * db) / (na + nb) - na * nb * h / (na + nb) ** 2
        elif method == "average":
            new = (na * da + nb * db) / (na + nb)
        else:
            new = np.minimum(da, db) if method == "single" else np.maximum(da, db)
        lo, hi = sorted((name[a], name[b]))
        out[t] = lo, hi, np.sqrt(max(h, 0.0)) if method in ("ward", "centroid") else h, na + nb
        alive[b] = False
        d[b], d[:, b], gap[b] = np.inf, np.inf, np.inf
        d[a, rest] = d[rest, a] = new
        size[a], name[a] = na + nb, n + t
        stale = rest & ((near == a) | (near == b))
        stale[a] = True
        for k in np.flatnonzero(stale):
            near[k] = int(d[k].argmin())
            gap[k] = d[k, near[k]]
        closer = rest & ~stale & (d[:, a] < gap)
        near[closer], gap[closer] = a, d[closer, a]
    return out


def cut(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels 1..k after the first n - k merges in order of height."""
    parent = np.arange(2 * n)
    order = np.argsort(merges[:, 2], kind="stable") if len(merges) else []
    made = {n + t: (int(m[0]), int(m[1])) for t, m in enumerate(merges)}
    for t in list(order)[: n - k]:
        for child in made[n + t]:
            parent[child] = n + t

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    labels, out = {}, np.zeros(n, int)
    for i in range(n):
        out[i] = labels.setdefault(root(i), len(labels) + 1)
    return out


def cophenetic(merges: np.ndarray, n: int) -> np.ndarray:
    """Height at which each pair of the sample is joined."""
    members = {i: np.array([i]) for i in range(n)}
    out = np.zeros((n, n))
    for t, (a, b, h, _) in enumerate(merges):
        x, y = members.pop(int(a)), members.pop(int(b))
        out[np.ix_(x, y)] = h
        out[np.ix_(y, x)] = h
        members[n + t] = np.concatenate([x, y])
    return out


def cophenetic_correlation(x: np.ndarray, merges: np.ndarray) -> float:
    up = np.triu_indices(len(x), 1)
    a, b = distances(x)[up], cophenetic(merges, len(x))[up]
    return float(np.corrcoef(a, b)[0, 1]) if len(a) > 1 and a.std() > 0 and b.std() > 0 else float("nan")


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean Euclidean silhouette of a bounded sample; NaN for fewer than two clusters or none but singles."""
    groups = np.unique(labels)
    if len(groups) < 2 or len(groups) >= len(x):
        return float("nan")
    d = distances(x)
    size = np.array([(labels == g).sum() for g in groups])
    mean = np.stack([d[:, labels == g].sum(axis=1) for g in groups], axis=1)
    own = np.searchsorted(groups, labels)
    rows = np.arange(len(x))
    a = mean[rows, own] / np.maximum(size[own] - 1, 1)
    other = mean / size
    other[rows, own] = np.inf
    b = other.min(axis=1)
    s = np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(s.mean())


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 300, tolerance: float = 1e-4, rows: int = 8192) -> tuple[float, np.ndarray]:
    """(summed squared distances, centres) of one start: k-means++ seeds, then rounds until the centres' squared moves sum to at most tolerance times the mean variance of the columns.

    A cluster that loses all its points keeps its centre; rows are taken a few thousand at a time.
    """
    rng = np.random.default_rng(seed)
    size = np.einsum("ij,ij->i", x, x)
    centres = x[[rng.integers(len(x))]]
    nearest = np.full(len(x), np.inf)
    while len(centres) < k:
        c = centres[-1]
        nearest = np.minimum(nearest, np.maximum(size - 2 * (x @ c) + c @ c, 0))
        total = nearest.cumsum()
        at = int(np.searchsorted(total, rng.random() * total[-1], side="right")) if total[-1] > 0 else int(rng.integers(len(x)))
        centres = np.vstack([centres, x[min(at, len(x) - 1)]])
    enough = tolerance * float(x.var(axis=0).mean())
    for step in range(rounds + 1):
        sums, counts, cost = np.zeros_like(centres), np.zeros(k), 0.0
        half = np.einsum("ij,ij->i", centres, centres) / 2
        for a in range(0, len(x), rows):
            part = x[a : a + rows]
            score = part @ centres.T - half
            own = score.argmax(axis=1)
            cost += float(size[a : a + rows].sum() - 2 * score[np.arange(len(part)), own].sum())
            counts += np.bincount(own, minlength=k)
            for j in range(x.shape[1]):
                sums[:, j] += np.bincount(own, weights=part[:, j], minlength=k)
        if step == rounds:
            break
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        shift = float(((moved - centres) ** 2).sum())
        centres = moved
        if shift <= enough:
            break
    return max(cost, 0.0), centres
