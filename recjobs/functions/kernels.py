"""Small dense solvers, numpy only: one target's system at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def ridge_gram(gram: np.ndarray, target: np.ndarray, alpha: float) -> np.ndarray:
    """Minimise |y - Xw|^2 + alpha |w|^2, given X'X and X'y."""
    return np.linalg.solve(gram + alpha * np.eye(len(gram)), target)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all runs of these starts and lengths, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def enet_gram(gram: np.ndarray, target: np.ndarray, n: int, alpha: float, l1_ratio: float, positive: bool = True, steps: int = 1000, tolerance: float = 1e-9) -> np.ndarray:
    """Minimise |y - Xw|^2 / 2n + alpha (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2) by coordinates."""
    g, c = gram / n, target / n
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    w, residual = np.zeros(len(c)), c.copy()  # residual = c - g w
    for _ in range(steps):
        moved = 0.0
        for j in range(len(c)):
            if g[j, j] <= 0:
                continue
            rho = residual[j] + g[j, j] * w[j]
            new = max(rho - l1, 0.0) if positive else np.sign(rho) * max(abs(rho) - l1, 0.0)
            new /= g[j, j] + l2
            if new != w[j]:
                residual -= g[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]))
                w[j] = new
        if moved < tolerance:
            break
    return w


def logistic_newton(x: np.ndarray, sign: np.ndarray, c: float, steps: int = 50) -> np.ndarray:
    """Minimise |w|^2 / 2 + c sum log(1 + exp(-y xw)), without an intercept."""
    w = np.zeros(x.shape[1])
    loss = lambda v: 0.5 * v @ v + c * np.logaddexp(0, -sign * (x @ v)).sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(sign * (x @ w), -40, 40)))
        gradient = w - c * (x.T @ (sign * (1 - p)))
        if np.abs(gradient).max(initial=0) < 1e-9:
            break
        step = np.linalg.solve(np.eye(len(w)) + c * (x.T * (p * (1 - p))) @ x, gradient)
        rate = 1.0
        while rate > 1e-6 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
    return w


def svm_squared_hinge(x: np.ndarray, sign: np.ndarray, c: float, steps: int = 100) -> np.ndarray:
    """Minimise |w|^2 / 2 + c sum max(0, 1 - y xw)^2, without an intercept, by Newton steps."""
    w = np.zeros(x.shape[1])
    loss = lambda v: 0.5 * v @ v + c * (np.maximum(0, 1 - sign * (x @ v)) ** 2).sum()
    for _ in range(steps):
        slack = 1 - sign * (x @ w)
        active = slack > 0
        gradient = w - 2 * c * (x[active].T @ (sign[active] * slack[active]))
        if np.abs(gradient).max(initial=0) < 1e-9:
            break
        step = np.linalg.solve(np.eye(len(w)) + 2 * c * x[active].T @ x[active], gradient)
        rate = 1.0
        while rate > 1e-6 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
    return w


def logistic_terms(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each margin y xw: its loss log(1 + exp(-m)), the slope 1 - p and the bend p (1 - p)."""
    p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
    return np.logaddexp(0, -margin), 1 - p, p * (1 - p)


def squared_hinge_terms(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each margin: its loss max(0, 1 - m)^2, and half of its slope and bend."""
    slack = np.maximum(0, 1 - margin)
    return slack**2, slack, (slack > 0) * 1.0


def lottery_merge(lists: list[list[int]], shares: list[float], n: int, draws: Iterator[float], decay: float = 1.5) -> list[tuple[int, int]]:
    """``(item, list)``: take heads of lists drawn with share * decay**(left - n), skipping repeats.
    A draw in [0, 1) takes the first list at which the running weight passes that share of the whole."""
    left, out, seen = [list(x) for x in lists], [], set()
    while len(out) < n and any(left):
        weights = [p * decay ** (len(x) - n) if x else 0.0 for p, x in zip(shares, left)]
        place, run = next(draws) * sum(weights), 0.0
        for k, w in enumerate(weights):
            run += w
            if w and (run > place or not any(left[k + 1 :])):
                break
        item = left[k].pop(0)
        if item not in seen:
            seen.add(item)
            out.append((item, k))
    return out
