"""Logistic regression on bounded matrices (numpy), shared by the trained operators."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class Logistic:
    """L2-regularised logistic regression on standardised features, fitted by accelerated descent."""

    def __init__(self, l2: float = 1e-3, steps: int = 150):
        self.l2, self.steps = l2, steps

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "Logistic":
        x = np.asarray(x, np.float32)
        y = np.asarray(y, np.float32)
        w = np.ones(len(y), np.float32) if weight is None else np.asarray(weight, np.float32)
        w = w / w.sum()
        mean = (w @ x).astype(np.float32)
        square = np.zeros(x.shape[1], np.float32)
        for lo in range(0, len(x), 512):  # no second matrix of the size of x
            part = x[lo:lo + 512]
            square += w[lo:lo + 512] @ (part * part)
        spread = np.sqrt(np.maximum(square - mean * mean, 0))
        scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0).astype(np.float32)
        # the step size follows the largest curvature (power iteration on the weighted Gram matrix)
        v = np.ones(x.shape[1], np.float32) / np.sqrt(x.shape[1])
        top = 1.0
        for _ in range(12):
            u = x @ (v * scale) - mean @ (v * scale)
            g = scale * (x.T @ (w * u) - mean * (w @ u))
            top = float(np.linalg.norm(g)) or 1.0
            v = g / top
        rate = 1.0 / (0.25 * top * 1.1 + self.l2 + 0.25)
        beta = np.zeros(x.shape[1], np.float32)
        base = float(np.clip(w @ y, 1e-4, 1 - 1e-4))
        bias = float(np.log(base / (1 - base)))
        old, old_bias = beta, bias
        for t in range(self.steps):
            m = t / (t + 3)
            look, look_bias = beta + m * (beta - old), bias + m * (bias - old_bias)
            d = look * scale
            r = w * (sigmoid(x @ d - mean @ d + look_bias) - y)
            g = scale * (x.T @ r - mean * r.sum()) + self.l2 * look
            old, old_bias = beta, bias
            beta, bias = look - rate * g, look_bias - rate * float(r.sum())
        self.coef = (beta * scale).astype(np.float64)
        self.bias = float(bias - mean @ self.coef)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coef + self.bias


class Platt:
    """Calibration of one view's logits: sigmoid(a * logit + b)."""

    def fit(self, z: np.ndarray, y: np.ndarray) -> "Platt":
        self.a, self.b = 1.0, 0.0
        if len(z) == 0 or y.min() == y.max():
            return self
        # Platt's smoothed targets keep perfectly separated samples finite
        up, down = y.sum(), len(y) - y.sum()
        target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
        z = np.clip(z, -30, 30)
        a, b = 1.0, 0.0
        for _ in range(60):
            p = sigmoid(a * z + b)
            s = np.maximum(p * (1 - p), 1e-9)
            g = np.array([np.sum((p - target) * z) + 1e-3 * (a - 1), np.sum(p - target)])
            h = np.array([[np.sum(s * z * z) + 1e-3, np.sum(s * z)], [np.sum(s * z), np.sum(s) + 1e-9]])
            step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
            step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        if a > 0:  # a view that ranks the wrong way round stays uncalibrated
            self.a, self.b = float(a), float(b)
        return self

    def __call__(self, z):
        return self.a * np.clip(z, -30, 30) + self.b
