"""Faster convergence of covariance estimates that improve round by round."""

from __future__ import annotations

import numpy as np

LONGEST = 16.0


class Accelerated:
    """Squared extrapolation of a slow sequence of spreads, in the logarithm of their Cholesky factor.

    Two plain steps give the direction and its change; the third start lies where they point.
    """

    def __init__(self, spread: np.ndarray):
        self.seen = [self._packed(spread)]
        self.p = len(spread)

    def _packed(self, spread: np.ndarray) -> np.ndarray:
        lower = np.linalg.cholesky(spread)
        return np.concatenate([np.log(np.diag(lower)), lower[np.tril_indices(len(spread), -1)]])

    def next(self, spread: np.ndarray) -> np.ndarray:
        """The spread to go on from, after a plain step reached ``spread``."""
        self.seen.append(self._packed(spread))
        if len(self.seen) < 3:
            return spread
        first, second, third = self.seen
        step, turn = second - first, third - 2 * second + first
        length = float(np.clip(np.linalg.norm(step) / max(np.linalg.norm(turn), 1e-300), 1.0, LONGEST))
        jump = first + 2 * length * step + length**2 * turn
        # A jump of more than e-fold in a standard deviation is not trusted.
        if not np.all(np.isfinite(jump)) or np.max(np.abs(jump[: self.p] - third[: self.p])) > 1.0:
            jump = third
        self.seen = [jump]
        lower = np.diag(np.exp(jump[: self.p]))
        lower[np.tril_indices(self.p, -1)] = jump[self.p :]
        return lower @ lower.T
