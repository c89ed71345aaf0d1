"""Probabilities from raw margins."""

from __future__ import annotations

import numpy as np


def platt(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift so that 1 / (1 + exp(-(slope * margin + shift))) is a calibrated probability of good.

    Targets are smoothed as Platt proposed, so that cleanly separated margins still give a finite slope; the slope is never negative."""
    n_good, n_bad = int(good.sum()), int((~good).sum())
    if not n_good + n_bad:
        return 1.0, 0.0
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    scale = max(1e-9, float(np.abs(margin).mean()))
    x, a, c = margin / scale, 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
        k = p * (1 - p) + 1e-9
        g = np.array([((p - target) * x).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(k * x * x).sum() + 1e-3, (k * x).sum()], [(k * x).sum(), k.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 1.0 / max(1e-12, np.abs(d).max()))
        a, c = a - d[0], c - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return float(max(a, 1e-3) / scale), float(c)


def probability(margin: np.ndarray, slope: float, shift: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
