"""Linear hinge-loss models fitted by dual coordinate descent, and the map of margins to scores."""

from __future__ import annotations

import numpy as np


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, cost: np.ndarray, rounds: int = 20, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of an L1-loss support vector machine over sparse rows (columns, values).

    Minimises |w|^2 / 2 + sum cost_i * max(0, 1 - y_i w.x_i); the bias is one more column of 1.
    """
    w, bias, alpha = np.zeros(width), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(rows)):
            cols, values = rows[i]
            slope = y[i] * (float(w[cols] @ values) + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * y[i]) != 0.0:
                alpha[i] = new
                w[cols] += step * values
                bias += step
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def times(x: np.ndarray, w: np.ndarray, step: int = 2048) -> np.ndarray:
    """x @ w of a matrix of short floats, widened a part at a time."""
    w = w.astype(np.float32)
    return np.concatenate([np.empty(0), *(x[at : at + step].astype(np.float32) @ w for at in range(0, len(x), step))]).astype(float)


def dense_descent(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40, seed: int = 1) -> tuple[np.ndarray, float]:
    """The same over some rows of a matrix, whose labels and costs are y and cost; the matrix, which may be of short floats, is neither copied nor widened as a whole.

    A round visits only rows that can move, those with a multiplier or inside the margin, so that many easy rows cost little.
    """
    w, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(rows))
    square = np.concatenate([np.empty(0), *(np.square(x[at : at + 2048].astype(np.float32)).sum(axis=1) for at in range(0, len(x), 2048))])[rows] + 1.0
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        margins = y * (times(x, w)[rows] + bias)
        for i in order.permutation(np.nonzero((alpha > 0) | (margins < 1))[0]):
            row = x[rows[i]].astype(float)
            slope = y[i] * (float(row @ w) + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * y[i]) != 0.0:
                alpha[i] = new
                w += step * row
                bias += step
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def logistic(margins: np.ndarray, y: np.ndarray, weights: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (margin, 0/1), by Newton's method with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([np.sum(weights * (p - y) * margins) + 1e-2 * a, np.sum(weights * (p - y))])
        h = weights * p * (1 - p) + 1e-9
        hess = np.array([[np.sum(h * margins * margins) + 1e-2, np.sum(h * margins)], [np.sum(h * margins), np.sum(h) + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-6:
            break
    return (a, b) if a > 0 else (1.0, 0.0)
