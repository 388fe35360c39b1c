"""RBF machine with squared hinge loss: Nyström features of landmark rows, and Newton's steps on sums over rows."""

from __future__ import annotations

import numpy as np


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |x - y|^2) of all rows of ``x`` with all rows of ``y``."""
    return np.exp(-gamma * np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0.0))


def projection(landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """From kernel values with the landmarks to features whose inner products are the kernel among landmarks, and close to it elsewhere."""
    values, vectors = np.linalg.eigh(rbf(landmarks, landmarks, gamma))
    real = values > 1e-10 * values[-1]
    return vectors[:, real] / np.sqrt(values[real])


def lift(x: np.ndarray, landmarks: np.ndarray, project: np.ndarray, gamma: float) -> np.ndarray:
    """Features of rows; the last is the constant one."""
    return np.hstack([rbf(x, landmarks, gamma) @ project, np.ones((len(x), 1))])


def sums(z: np.ndarray, y: np.ndarray, cost: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """What some rows add to the loss, its gradient and its Hessian; ``y`` is -1 or 1."""
    lacks = 1 - y * (z @ w)
    at = lacks > 0
    z, y, cost, lacks = z[at], y[at], cost[at], lacks[at]
    return float((cost * lacks**2).sum()), -2 * z.T @ (cost * y * lacks), 2 * (z.T * cost) @ z


def newton(loss: float, gradient: np.ndarray, hessian: np.ndarray, w: np.ndarray) -> tuple[float, float, np.ndarray]:
    """The objective at ``w``, what a Newton step is expected to gain, and where it leads; the constant's weight is free."""
    shrunk = np.append(np.ones(len(w) - 1), 1e-9)
    gradient = gradient + shrunk * w
    step = -np.linalg.solve(hessian + np.diag(shrunk), gradient)
    return loss + 0.5 * float((shrunk * w * w).sum()), -0.5 * float(gradient @ step), w + step
