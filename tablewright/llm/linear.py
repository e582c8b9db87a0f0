"""A logistic model fitted on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


def fit_sparse(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, target: np.ndarray, dims: int, l2: float = 1e-4, steps: int = 300, rate: float = 0.5) -> np.ndarray:
    """Weights (the last is the intercept) for soft targets, by full-batch Adam; deterministic."""
    w, m, v, n = np.zeros(dims + 1), np.zeros(dims + 1), np.zeros(dims + 1), len(target)
    for t in range(1, steps + 1):
        z = np.bincount(rows, values * w[cols], n) + w[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g = np.append(np.bincount(cols, values * d[rows], dims) + l2 * w[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (0.5 if t > steps // 2 else 1)
    return w


def fit_dense(x: np.ndarray, target: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method; `weight` is each row's."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - target)) + l2 * len(x) * np.append(w[:-1], 0)
        h = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + l2 * len(x) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
