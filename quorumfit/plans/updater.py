"""Update strategy of a consensus fit."""

from __future__ import annotations

import numpy as np

from quorumfit.operators import local_solve, steps


class SquaredL2:
    """L2-regularised logistic regression. Subclass it to change any of the steps.

    ``loss`` and ``dual_update`` work on the rows and state of a block inside tasks; the
    global steps work on the summary of all states, D numbers and a few scalars. ``local_update`` may be set
    to a function ``(rows, w, u, z, rho) -> w`` that replaces the local solver.
    """

    local_update = None
    loss = staticmethod(local_solve.logistic_sums)
    dual_update = staticmethod(local_solve.dual_update)

    def __init__(
        self,
        lam: float = 0.01,
        eps_abs: float = 1e-3,
        eps_rel: float = 1e-3,
        criterion: str = "primal",
        free_last: bool = False,
    ):
        if criterion not in ("primal", "both"):
            raise ValueError("criterion is 'primal' or 'both'")
        self.lam, self.eps_abs, self.eps_rel = lam, eps_abs, eps_rel
        self.criterion, self.free_last = criterion, free_last

    def z_update(self, w_avg: np.ndarray, u_avg: np.ndarray, rho: float, n: int) -> np.ndarray:
        z = steps.consensus(w_avg, u_avg, rho, n, self.lam)
        if self.free_last:
            z[-1] = w_avg[-1] + u_avg[-1]
        return z

    def tolerance(self, n: int, w_norm: float, z_norm: float) -> float:
        return steps.primal_tolerance(n, max(w_norm, z_norm), self.eps_abs, self.eps_rel)

    def converged(self, primal: float, dual: float, tolerance: float, rho: float) -> bool:
        """Primal residual within tolerance; with criterion ``both`` also the movement
        sqrt(N)*||z - z_prev|| = dual / rho."""
        settled = self.criterion == "primal" or dual <= rho * tolerance
        return primal <= tolerance and settled

    def next_rho(self, rho: float, primal: float, dual: float) -> float:
        return steps.next_penalty(rho, primal, dual)


class ElasticNet(SquaredL2):
    """lam * (l1_ratio * |z| + (1 - l1_ratio) * ||z||^2) in place of lam * ||z||^2: the z-step
    is a soft threshold by coordinate, so weights that do not pay their price are exactly
    zero. ``l1_ratio`` 1 is the lasso. The intercept is free of it."""

    def __init__(self, lam: float = 0.01, l1_ratio: float = 1.0, **options):
        super().__init__(lam, **options)
        if not 0.0 <= l1_ratio <= 1.0:
            raise ValueError("l1_ratio is between 0 and 1")
        self.l1_ratio = l1_ratio

    def z_update(self, w_avg: np.ndarray, u_avg: np.ndarray, rho: float, n: int) -> np.ndarray:
        z = steps.elastic_consensus(w_avg, u_avg, rho, n, self.lam, self.l1_ratio)
        if self.free_last:
            z[-1] = w_avg[-1] + u_avg[-1]
        return z
