"""Logistic loss with a ridge penalty by Newton steps, on a bounded matrix of features or on sums from elsewhere."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], penalty: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights that minimise a loss of which ``sums`` gives slope and curvature at any weights."""
    w = np.zeros(len(penalty))
    for _ in range(steps):
        slope, curve = sums(w)
        step = np.linalg.solve(curve + np.diag(penalty), slope + penalty * w)
        scale = min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        w = w - scale * step
        if np.abs(step).max() < 1e-7:
            break
    return w


def loss_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the loss of some rows, without penalty."""
    p = sigmoid(x @ w)
    return x.T @ (p - y), (x * (p * (1 - p) + 1e-9)[:, None]).T @ x


def fit(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 30, free: int | None = None) -> np.ndarray:
    """Weights that minimise the loss; column ``free`` (the constant) is not penalised."""
    penalty = np.full(x.shape[1], ridge)
    if free is not None:
        penalty[free] = 1e-6
    return newton(lambda w: loss_sums(x, y, w), penalty, steps)
