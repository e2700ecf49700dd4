"""Local regression over the genes of one batch."""

from __future__ import annotations

import numpy as np


def expected_spread(mean: np.ndarray, var: np.ndarray, span: float) -> np.ndarray:
    """Standard deviation expected at each mean: tricube-weighted local quadratics of log10 variance on log10 mean; 0 for constant genes."""
    out = np.zeros(len(mean))
    use = (var > 0) & (mean > 0)
    x, y = np.log10(mean[use]), np.log10(var[use])
    n = len(x)
    if n == 0:
        return out
    k = min(n, max(3, int(np.ceil(span * n))))
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    fit = np.empty(n)
    left = 0
    for i in range(n):
        while left + k < n and xs[left + k] - xs[i] < xs[i] - xs[left]:
            left += 1
        px, py = xs[left : left + k] - xs[i], ys[left : left + k]
        reach = np.abs(px).max()
        w = np.clip(1 - (np.abs(px) / reach) ** 3, 0, None) ** 1.5 if reach > 0 else np.ones(k)
        a = np.stack([np.ones(k), px, px * px], axis=1) * w[:, None]
        fit[i] = np.linalg.lstsq(a, py * w, rcond=None)[0][0]
    spread = np.empty(n)
    spread[order] = np.sqrt(10.0**fit)
    out[use] = spread
    return out
