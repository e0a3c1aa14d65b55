"""Factor paths of one panel inside a task, all simulations at once."""

from __future__ import annotations

import numpy as np


def factor_paths(rng: np.random.Generator, sims: int, horizon: int, model) -> np.ndarray:
    """Simulated factors (sims, horizon, K) from independent AR(1) dynamics."""
    c, phi, sigma, f = (np.asarray(model[name], dtype=float) for name in ("c", "phi", "sigma", "f_last"))
    out = np.zeros((sims, horizon, len(f)))
    for h in range(horizon):
        f = c + phi * f + sigma * rng.standard_normal((sims, len(c)))
        out[:, h] = f
    return out
