"""Best match of arrays to models that start at zero, for many pairs at once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np


def difference(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) != len(b) or not len(a):
        raise ValueError("arrays must have the same length above 0")
    return float(np.sum(np.abs(a - b)))


def _left_out(long: np.ndarray, short: np.ndarray) -> np.ndarray:
    """For each row of ``long`` (rows, n), which columns to leave out so that the rest is nearest to that row of ``short``.

    Costs to go over (column of long, column of short) by dynamic programming; leaving out wins ties, so of
    equals the first in the order of indices left out is taken.
    """
    rows, n = long.shape
    m = short.shape[1]
    k = n - m
    cost = np.full((n + 2, m + 2, rows), np.inf)
    cost[n, m] = 0
    for i in range(n - 1, -1, -1):
        for j in range(min(i, m), max(i - k, 0) - 1, -1):
            out = cost[i + 1, j] if i + 1 - j <= k else np.inf
            keep = np.abs(long[:, i] - short[:, j]) + cost[i + 1, j + 1] if j < m else np.inf
            cost[i, j] = np.minimum(out, keep)
    gone, j, own = np.zeros((rows, n), bool), np.zeros(rows, np.int64), np.arange(rows)
    for i in range(n):
        gone[:, i] = (i + 1 - j <= k) & (cost[i + 1, j, own] == cost[i, j, own])
        j += ~gone[:, i]
    return gone


def surplus(base: np.ndarray, model: np.ndarray) -> np.ndarray:
    """For each row, which columns of ``base`` to leave out; the model begins at the first value kept."""
    rows, n = base.shape
    k = n - model.shape[1]
    best, gone = np.full(rows, np.inf), np.zeros((rows, n), bool)
    for s in range(k + 1):  # the first value kept fixes the model's place
        placed = model + base[:, s : s + 1]
        now = np.zeros((rows, n), bool)
        now[:, :s] = True
        now[:, s + 1 :] = _left_out(base[:, s + 1 :], placed[:, 1:])
        cost = np.abs(base[~now].reshape(rows, -1) - placed).sum(1)
        better = cost <= best  # of equals the one that leaves out more at the beginning
        best[better], gone[better] = cost[better], now[better]
    return gone


def best_matches(bases: Sequence[np.ndarray], models: Sequence[np.ndarray], most_difference: float | None = None) -> list[tuple[np.ndarray, float]]:
    """Each base with surplus values left out or missing ones taken from its model, and its summed difference.

    Beyond ``most_difference`` the model itself, put at the first value of the base, is the result. Pairs of
    equal sizes are computed together.
    """
    groups: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, (b, m) in enumerate(zip(bases, models)):
        if not isinstance(b, np.ndarray) or not isinstance(m, np.ndarray):
            raise TypeError("base and model must be arrays")
        if not len(b) or not len(m):
            raise ValueError("base and model must not be empty")
        groups[len(b), len(m)].append(i)
    out: list = [None] * len(bases)
    for (n, k), own in groups.items():
        base, model = np.stack([bases[i] for i in own]).astype(float), np.stack([models[i] for i in own]).astype(float)
        placed = model + base[:, :1]
        if n > k:
            got = base[~surplus(base, model)].reshape(len(own), k)
            diff = np.abs(got - (model + got[:, :1])).sum(1)
        elif n < k:
            got, gone = placed.copy(), _left_out(placed, base)
            got[~gone] = base.ravel()
            diff = np.abs(got - placed).sum(1)
        else:
            got, diff = base.copy(), np.abs(base - placed).sum(1)
        if most_difference is not None:
            far = diff > most_difference
            got[far], diff[far] = placed[far], 0.0
        for i, g, d in zip(own, got, diff.tolist()):
            out[i] = (g, d)
    return out


def best_match(base: np.ndarray, model: np.ndarray, most_difference: float | None = None) -> tuple[np.ndarray, float]:
    """``best_matches`` of one pair."""
    return best_matches([base], [model], most_difference)[0]
