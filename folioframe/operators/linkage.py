"""Agglomerative trees of one-dimensional values in numpy, for modes a window cannot express."""

from __future__ import annotations

import numpy as np


#: How the distance of two groups is taken: nearest or farthest members, means, the means of merged groups' means, or the
#: growth of the sum of squares. In one dimension the centroid is the mean, and the median rule the weighted one.
METHODS = ("single", "complete", "average", "centroid", "weighted", "median", "ward")


def tree(values: np.ndarray, method: str = "single") -> np.ndarray:
    """Merges (left, right, height, size) of sorted values; only neighbours ever merge in one dimension."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    halves = method in ("weighted", "median")
    groups = [(i, float(v), float(v), float(v), 1) for i, v in enumerate(values)]  # node, least, most, mean, size
    merges = []

    def distance(a, b) -> float:
        if method == "ward":
            return float(np.sqrt(2 * a[4] * b[4] / (a[4] + b[4]))) * (b[3] - a[3])
        return b[1] - a[2] if method == "single" else b[2] - a[1] if method == "complete" else b[3] - a[3]

    while len(groups) > 1:
        k = int(np.argmin([distance(a, b) for a, b in zip(groups, groups[1:])]))
        a, b = groups[k], groups[k + 1]
        size = a[4] + b[4]
        merges.append((a[0], b[0], distance(a, b), size))
        groups[k : k + 2] = [(len(values) + len(merges) - 1, a[1], b[2], (a[3] + b[3]) / 2 if halves else (a[3] * a[4] + b[3] * b[4]) / size, size)]
    return np.array(merges, float).reshape(-1, 4)


def inconsistency(merges: np.ndarray, depth: int = 2) -> np.ndarray:
    """Of every merge: its height less the mean of those down to ``depth`` levels, by their deviation."""
    n = len(merges) + 1
    out = np.zeros(len(merges))

    def heights(k: int, left: int) -> list[float]:
        if k < n or left == 0:
            return []
        a, b, h, _ = merges[k - n]
        return [h, *heights(int(a), left - 1), *heights(int(b), left - 1)]

    for i in range(len(merges)):
        h = heights(n + i, depth)
        spread = np.std(h, ddof=1) if len(h) > 1 else 0.0
        out[i] = (merges[i, 2] - np.mean(h)) / spread if spread > 0 else 0.0
    return out


def cut_tree(merges: np.ndarray, threshold: float, criterion: str, depth: int = 2) -> np.ndarray:
    """0-based cluster of every value, in value order; ``maxclust`` takes the number of clusters as threshold."""
    n = len(merges) + 1
    if criterion == "distance":
        measure = merges[:, 2]
    elif criterion == "inconsistent":
        measure = inconsistency(merges, depth)
    elif criterion == "maxclust":
        measure, threshold = np.arange(len(merges), dtype=float), n - threshold - 1
    else:
        raise ValueError("criterion must be 'distance', 'inconsistent' or 'maxclust'")
    most = measure.copy()  # of a merge and all below it
    for i, (a, b, *_) in enumerate(merges):
        for c in (int(a), int(b)):
            if c >= n:
                most[i] = max(most[i], most[c - n])
    top = np.arange(n + len(merges))
    for i in range(len(merges) - 1, -1, -1):
        if most[i] <= threshold:
            top[[int(merges[i, 0]), int(merges[i, 1])]] = top[n + i]
    order = {t: k for k, t in enumerate(dict.fromkeys(top[:n].tolist()))}
    return np.array([order[t] for t in top[:n].tolist()])
