"""Marginal likelihood of one room, its gradient, and its maximisation over many rooms.

A room's effect is ``u = L z`` with ``z ~ N(0, I)``, so a spread of lower rank needs no
inverse. ``z`` is integrated out: by adaptive Gauss-Hermite nodes around the room's mode
where few effects allow it, else by Laplace's method with the third derivatives that its
gradient needs. Everything here is numpy for many rooms and many parameter sets at once;
``rooms`` runs it inside batches of rooms and adds the rooms up in one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Gauss-Hermite nodes in each direction, by the number of effects; more effects go by Laplace's method.
NODES = {1: 31, 2: 21}
#: A Newton step of this size leaves an error of its square.
NEWTON_STEPS, SETTLED, STILL = 60, 1e-6, 1e-9
#: A Newton step that moves no predictor by more than this gains likelihood; so many of them are taken at first.
SAFE, SHORT_STEPS = 1.5, 12
#: Chances of so many trials may be multiplied: each is at least a half.
MULTIPLIED = 1000
#: A step moves no parameter by more than this.
LONGEST = 2.0
#: Lengths of a step that one pass tries, the whole one first; distance of the points that show the curvature, and its least value.
LENGTHS = (1.0, 0.4, 0.1, 2.5)
NEXT, LEAST_CURVATURE = 1e-5, 0.5


def packed(lower: np.ndarray) -> np.ndarray:
    """The lower triangle, row by row."""
    return lower[..., *np.tril_indices(lower.shape[-1])]


def unpacked(values: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((*values.shape[:-1], p, p))
    rows, columns = np.tril_indices(p)
    out[..., rows, columns] = values
    return out


def hermite(p: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (K, p) and log weights of the standard normal."""
    t, w = np.polynomial.hermite_e.hermegauss(nodes)
    grid = np.stack(np.meshgrid(*[t] * p, indexing="ij"), axis=-1).reshape(-1, p)
    weight = np.stack(np.meshgrid(*[np.log(w / w.sum())] * p, indexing="ij"), axis=-1).reshape(-1, p)
    return grid, weight.sum(axis=1)


@dataclass
class Rows:
    """Covariate patterns of a room: design rows, trials and successes.

    All arrays may have a leading axis of rooms of about one size; a shorter room is filled up with rows of no
    trials. Coefficients are (sets, p) for one room and (rooms, sets, p) for many, here and in ``Expansion``.
    """

    x: np.ndarray
    n: np.ndarray
    k: np.ndarray

    @cached_property
    def _squares(self) -> np.ndarray:
        return (self.x[..., :, None] * self.x[..., None, :]).reshape(*self.x.shape[:-1], -1)

    def __getitem__(self, some) -> Rows:
        return Rows(self.x[some], self.n[some], self.k[some])

    def _scores(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        eta = beta @ self.x.mT
        small = np.exp(-np.abs(eta))
        value = eta @ self.k[..., None] - (np.maximum(eta, 0) + np.log(1 + small)) @ self.n[..., None]
        return value[..., 0], np.where(eta >= 0, 1.0, small) / (1 + small)

    def at(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable]:
        """(log likelihood, gradient, information) for many coefficients, and the third derivatives' product with a matrix."""
        value, mu = self._scores(beta)
        n = self.n[..., None, :]
        weight = n * mu * (1 - mu)
        h = (weight @ self._squares).reshape(*weight.shape[:-1], *2 * beta.shape[-1:])

        def third(a: np.ndarray) -> np.ndarray:
            spread = a.reshape(*a.shape[:-2], -1) @ self._squares.mT
            return (weight * (1 - 2 * mu) * spread) @ self.x

        return value, (self.k[..., None, :] - n * mu) @ self.x, h, third

    def slope(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value, mu = self._scores(beta)
        return value, (self.k[..., None, :] - self.n[..., None, :] * mu) @ self.x


@dataclass
class Expansion:
    """A room too large to be held as rows: value, gradient, information and third derivatives at ``centre``.

    The centre is moved to the room's mode again and again, so nothing is left out at the end.
    """

    centre: np.ndarray
    base: float | np.ndarray
    g: np.ndarray
    h: np.ndarray
    t: np.ndarray

    def __getitem__(self, some) -> Expansion:
        return Expansion(self.centre[some], self.base[some], self.g[some], self.h[some], self.t[some])

    def at(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable]:
        own = self.h[..., None, :, :]
        h = own + np.einsum("...ijk,...sk->...sij", self.t, beta - self.centre[..., None, :])
        floor = np.linalg.eigvalsh(h)[..., 0] <= 0  # too far from the centre for third derivatives
        h = np.where(floor[..., None, None], own, h)
        third = lambda a: np.where(floor[..., None], 0.0, np.einsum("...ijk,...sij->...sk", self.t, a))
        return *self.slope(beta), h, third

    def slope(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        move = beta - self.centre[..., None, :]
        bent = move @ self.h
        return np.asarray(self.base)[..., None] + (move * (self.g[..., None, :] - 0.5 * bent)).sum(axis=-1), self.g[..., None, :] - bent


def _shifted(intercept: np.ndarray, lower: np.ndarray, z: np.ndarray) -> np.ndarray:
    beta = (lower @ z[..., None])[..., 0]
    beta[..., 0] += intercept
    return beta


def _curved(room: Rows | Expansion, h: np.ndarray) -> np.ndarray:
    """The curvature of the room's own log likelihood, by which its mode moves."""
    return h if isinstance(room, Rows) else np.broadcast_to(room.h[..., None, :, :], h.shape)


def modes(room: Rows | Expansion, intercept: np.ndarray, lower: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Mode of ``z`` for every room and parameter set, by Newton steps that never lose likelihood; there is but one, wherever they start."""
    sets, p, _ = lower.shape
    turned, lead = lower.mT, room.h.shape[:-2] if isinstance(room, Expansion) else room.n.shape[:-1]
    z = np.zeros((*lead, sets, p)) if start is None else np.array(np.broadcast_to(start, (*lead, sets, p)))

    def score(room, z: np.ndarray) -> tuple:
        value, g, h, _ = room.at(_shifted(intercept, lower, z))
        return value - 0.5 * (z * z).sum(axis=-1), g, _curved(room, h)

    now, g, h = score(room, z)
    whole, rooms_left = z, None  # rooms that have settled are left where they are
    for _ in range(NEWTON_STEPS):
        step = np.linalg.solve(np.eye(p) + turned @ h @ lower, turned @ g[..., None] - z[..., None])[..., 0]
        for _ in range(30):
            new, g, h = score(room, z + step)
            worse = new < now - 1e-9 * (1 + np.abs(now))
            if not worse.any():
                break
            step[worse] /= 2
        z, now = z + step, new
        live = (np.abs(step) > SETTLED).any(axis=-1)
        if rooms_left is None:
            whole = z
        else:
            whole[rooms_left] = z
        if not live.any():
            break
        if lead:
            some = live.any(axis=-1)
            if 2 * some.sum() < len(some):
                rooms_left = np.flatnonzero(some) if rooms_left is None else rooms_left[some]
                room, z, now, g, h = room[some], z[some], now[some], g[some], h[some]
    return whole


class Laplace:
    """Rooms of about one size by Laplace's method, for many parameter sets around one of them.

    The rooms' modes under that one set are found first. Under another set a mode starts where the curvature found there
    sends it, and Newton steps follow until nothing moves. Arrays over patterns are (rooms, patterns, sets), so that sums
    over patterns are matrix products; others are (sets, numbers, rooms), and small matrices are worked off entry by entry.
    """

    def __init__(self, rows: Rows, intercept: float, lower: np.ndarray):
        many, p, self.rows = len(rows.n), rows.x.shape[-1], rows
        self.half = np.tril_indices(p)
        self.place = np.zeros((p, p), int)
        self.place[self.half] = np.arange(len(self.half[0]))
        self.place = np.maximum(self.place, self.place.T)
        self.x, self.n = np.ascontiguousarray(rows.x), rows.n[:, None]
        self.squares = self.x[..., self.half[0]] * self.x[..., self.half[1]]
        self.xn, self.squares_n = (np.ascontiguousarray((a * rows.n[..., None]).mT) for a in (self.x, self.squares))
        self.hits = (rows.k[:, None] @ self.x)[:, 0].T
        self.pull = self.hits - 0.5 * self.xn.sum(axis=-1).T
        self.reach = np.abs(self.x).max(axis=1).T
        # Bits of the trials: a room's chances are multiplied, which saves a logarithm for each pattern, unless the product could vanish.
        most = int(rows.n.max(initial=0)) if rows.n.sum(axis=1).max(initial=0) <= MULTIPLIED else 0
        self.bits = [(rows.n.astype(int) >> b & 1)[..., None] == 1 for b in range(most.bit_length())]
        self.z, self.centre, self.g, self.h = (np.zeros((k, many)) for k in (p, p, p, len(self.half[0])))
        for some, found in self._modes(np.array([intercept], float), np.array(lower, float)[None], np.zeros((1, p, many))):
            for name, kept in (("z", self.z), ("beta", self.centre), ("g", self.g), ("h", self.h)):
                kept[:, some] = found[name][0]

    def terms(self, intercept: np.ndarray, lower: np.ndarray, gradient: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """(log marginal likelihood, its gradient by (intercept, packed L), mode) of every room for every parameter set."""
        sets, p, _ = lower.shape
        many = self.z.shape[-1]
        z = np.broadcast_to(self.z, (sets, p, many))
        moved = self.h[self.place].transpose(2, 0, 1) @ _by_room(_placed(intercept, lower, z) - self.centre)
        z = z + self._step(lower, _folds(lower, self.half), z, self.g - moved.transpose(2, 1, 0), self.h, slice(None))[0]
        value, modes = np.empty((sets, many)), np.empty((sets, p, many))
        slope = np.empty((sets, 1 + len(self.half[0]), many)) if gradient else None
        for some, found in self._modes(intercept, lower, z):
            modes[..., some] = found["z"]
            value[:, some] = self._values(found, some)
            if gradient:
                slope[..., some] = self._slopes(lower, found, some)
        return value.T, slope.transpose(2, 0, 1) if gradient else None, modes.transpose(2, 0, 1)

    def _scores(self, beta: np.ndarray, some) -> dict:
        """Gradient and information of the rooms' own log likelihood, and their cells: predictors with their sign turned, chances, weights."""
        eta = self.x[some] @ _by_room(-beta)
        mu = np.exp(eta)
        mu += 1
        np.divide(1, mu, out=mu)
        weight = 1 - mu
        weight *= mu
        g = self.hits[:, some] - (self.xn[some] @ mu).transpose(2, 1, 0)
        return {"beta": beta, "eta": eta, "mu": mu, "weight": weight, "g": g, "h": np.ascontiguousarray((self.squares_n[some] @ weight).transpose(2, 1, 0))}

    def _step(self, lower: np.ndarray, folds: np.ndarray, z: np.ndarray, g: np.ndarray, h: np.ndarray, some) -> tuple[np.ndarray, dict]:
        """Newton step of ``z``, cut where it would move a predictor so far that likelihood could be lost, and the factor of its matrix."""
        factor = _factor(folds @ h, lower.shape[-1])
        step = np.stack(_solved(factor, list((lower.mT @ g - z).transpose(1, 0, 2))), axis=1)
        move = lower @ step
        if (np.abs(move) * self.reach[:, some]).sum(axis=1).max() > SAFE:  # no predictor moves by more than this sum
            moved = np.abs(self.x[some] @ _by_room(move)).max(axis=1)
            step *= np.minimum(1, SAFE / np.maximum(moved, SAFE)).T[:, None]
        return step, factor

    def _modes(self, intercept: np.ndarray, lower: np.ndarray, z: np.ndarray) -> Iterator[tuple]:
        """Rooms and what an evaluation at their modes gives, as they settle."""
        folds, some = _folds(lower, self.half), slice(None)
        for left in range(SHORT_STEPS, -1, -1):
            if not left:  # far from the first set: by longer steps, each of them looked at
                z = modes(self.rows[some], intercept, lower, z.transpose(2, 0, 1)).transpose(1, 2, 0)
            with np.errstate(over="ignore"):
                found = {"z": z} | self._scores(_placed(intercept, lower, z), some)
            step, found["factor"] = self._step(lower, folds, z, found["g"], found["h"], some)
            live = np.abs(step).max(axis=(0, 1)) > STILL
            if not left or not live.any():
                yield some, found
                return
            if 2 * live.sum() < len(live):  # rooms that have settled are left where they are
                rooms = np.arange(self.z.shape[-1])[some]
                yield rooms[~live], {k: _picked(k, v, ~live) for k, v in found.items()}
                some, z, step = rooms[live], z[..., live], step[..., live]
            z = z + step

    def _values(self, found: dict, some) -> np.ndarray:
        mu = found["mu"]
        if self.bits:
            likely, logs = np.maximum(mu, 1 - mu), 0.0
            for i, bit in enumerate(self.bits):
                likely = likely * likely if i else likely
                logs = logs + np.log(np.multiply.reduce(np.where(bit[some], likely, 1.0), axis=1).T)
        else:
            logs = (self.n[some] @ np.log(np.maximum(mu, 1 - mu)))[:, 0].T
        far = (self.n[some] @ np.abs(found["eta"]))[:, 0].T
        near = (self.pull[:, some] * found["beta"] - 0.5 * found["z"] ** 2).sum(axis=1)
        return near - 0.5 * far + logs - np.log(np.prod([v for (i, j), v in found["factor"].items() if i == j], axis=0))

    def _slopes(self, lower: np.ndarray, found: dict, some) -> np.ndarray:
        """Gradient of the rooms' terms by (intercept, packed L) at their modes."""
        p, pairs = lower.shape[-1], list(zip(*self.half))
        z, g = (list(a.transpose(1, 0, 2)) for a in (found["z"], found["g"]))
        h = [[found["h"][:, self.place[i, j]] for j in range(p)] for i in range(p)]
        low, factor = lower.transpose(1, 2, 0)[..., None], found["factor"]
        turned = _solved(factor, [low[:, i] for i in range(p)])  # L', by the curvature at the mode
        cover = [[sum(low[i, k] * turned[k][j] for k in range(i + 1)) for j in range(p)] for i in range(p)]
        halves = np.stack([cover[i][j] * (1 if i == j else 2) for i, j in pairs], axis=1)
        bent = self.squares[some] @ _by_room(halves)
        bent *= found["weight"] * (1 - 2 * found["mu"])
        c = list((self.xn[some] @ bent).transpose(1, 2, 0))
        # How the mode moves.
        w = _solved(factor, [sum(low[k, i] * c[k] for k in range(i, p)) for i in range(p)])
        lw = [sum(low[i, k] * w[k] for k in range(i + 1)) for i in range(p)]
        q = [0.5 * (sum(h[i][k] * lw[k] for k in range(p)) - c[i]) for i in range(p)]
        follow = [(i == 0) - sum(cover[i][k] * h[k][0] for k in range(p)) for i in range(p)]
        by = [g[0] - 0.5 * sum(c[i] * follow[i] for i in range(p))]
        by += [(g[i] + q[i]) * z[j] - sum(h[i][k] * turned[j][k] for k in range(p)) - 0.5 * g[i] * w[j] for i, j in pairs]
        return np.stack(by, axis=1)


def _placed(intercept: np.ndarray, lower: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Coefficients of many rooms (sets, numbers, rooms)."""
    beta = lower @ z
    beta[:, 0] += intercept[:, None]
    return beta


def _by_room(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values.transpose(2, 1, 0))


def _picked(name: str, value, some: np.ndarray):
    """The part of some rooms of what an evaluation gives."""
    if name == "factor":
        return {k: v[..., some] for k, v in value.items()}
    return value[some] if name in ("eta", "mu", "weight") else value[..., some]


def _folds(lower: np.ndarray, half: tuple) -> np.ndarray:
    """Matrices that take the lower half of ``H`` to that of ``L'HL``."""
    turned, (i, j) = lower.mT, half
    of = lambda a, b: turned[:, a[:, None], b]
    return of(i, i) * of(j, j) + np.where(i == j, 0.0, of(i, j) * of(j, i))


def _factor(halves: np.ndarray, p: int) -> dict:
    """Cholesky factors of ``I`` plus matrices given by their lower halves (sets, pairs, rooms); -1 has the inverse of the diagonal."""
    out: dict = {}
    for i in range(p):
        for j in range(i + 1):
            v = halves[:, i * (i + 1) // 2 + j] + (1.0 if i == j else 0.0)
            for k in range(j):
                v -= out[i, k] * out[j, k]
            if i > j:
                v *= out[j, -1]
            out[i, j] = np.sqrt(v) if i == j else v
        out[i, -1] = 1 / out[i, i]
    return out


def _solved(factor: dict, sides: list[np.ndarray]) -> list[np.ndarray]:
    """What the factored matrices take to ``sides``, given row by row."""
    found: list = []
    for i, v in enumerate(sides):
        for k in range(i):
            v = v - factor[i, k] * found[k]
        found.append(v * factor[i, -1])
    for i in reversed(range(len(found))):
        for k in range(i + 1, len(found)):
            found[i] -= factor[k, i] * found[k]
        found[i] *= factor[i, -1]
    return found


def room_terms(
    room: Rows | Expansion, intercept: np.ndarray, lower: np.ndarray, nodes: int | None = None, gradient: bool = True
) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(log marginal likelihood, its gradient by (intercept, packed L), mode) of every room for every parameter set."""
    sets, p, _ = lower.shape
    if nodes is None and isinstance(room, Rows):
        alone = room.n.ndim == 1
        found = Laplace(room[None] if alone else room, np.median(intercept), np.median(lower, axis=0)).terms(intercept, lower, gradient)
        return tuple(x[0] if alone and x is not None else x for x in found)
    # The first set's mode is near those of the others.
    near = modes(room, intercept[:1], lower[:1])
    z = near if sets == 1 else modes(room, intercept, lower, near)
    value, g, h, third = room.at(_shifted(intercept, lower, z))
    turned = lower.mT
    full = np.eye(p) + turned @ h @ lower
    logdet = np.linalg.slogdet(full)[1]
    if nodes is not None:
        t, weight = hermite(p, nodes)
        root = np.linalg.cholesky(np.linalg.inv(full))
        points = z[..., None, :] + np.einsum("...sij,kj->...ski", root, t)
        many, lead = len(t), z.shape[:-2]
        beta = _shifted(intercept[:, None], lower[:, None], points)
        loglik, g = room.slope(beta.reshape(*lead, sets * many, p))
        each = loglik.reshape(*lead, sets, many) - 0.5 * (points * points).sum(axis=-1) + 0.5 * (t * t).sum(axis=1) + weight
        top = each.max(axis=-1)
        share = np.exp(each - top[..., None])
        value = top + np.log(share.sum(axis=-1)) - 0.5 * logdet
        if not gradient:
            return value, None, z
        share /= share.sum(axis=-1, keepdims=True)
        g = share[..., None] * g.reshape(*lead, sets, many, p)
        return value, np.concatenate([g[..., 0].sum(axis=-1)[..., None], packed(g.mT @ points)], axis=-1), z
    value = value - 0.5 * (z * z).sum(axis=-1) - 0.5 * logdet
    if not gradient:
        return value, None, z
    inverse = np.linalg.inv(full)
    cover = lower @ inverse @ turned
    c = third(cover)
    # How the mode moves: by the curvature of the room's own log likelihood.
    own = _curved(room, h)
    moves = inverse if isinstance(room, Rows) else np.linalg.inv(np.eye(p) + turned @ own @ lower)
    w = (moves @ turned @ c[..., None])[..., 0]
    outer = lambda a, b: a[..., :, None] * b[..., None, :]
    by_l = outer(g, z) - h @ lower @ inverse - 0.5 * outer(c, z) - 0.5 * outer(g, w) + 0.5 * outer((own @ lower @ w[..., None])[..., 0], z)
    follow = -(lower @ moves @ turned @ own[..., :1])[..., 0]
    follow[..., 0] += 1
    by_b = g[..., 0] - 0.5 * (c * follow).sum(axis=-1)
    return value, np.concatenate([by_b[..., None], packed(by_l)], axis=-1), z


def gaussian_terms(h: np.ndarray, g: np.ndarray, n: float, y: float, yy: float, intercept: np.ndarray, lower: np.ndarray, sigma: np.ndarray):
    """The same for normal rows, from rooms' cross products; gradient by (intercept, packed L, log sigma). Exact.

    Returns (value, gradient, mean of z, covariance of z). ``h``, ``g``, ``n``, ``y`` and ``yy`` may have a leading axis of rooms.
    """
    p = lower.shape[-1]
    s2 = sigma**2
    h, g, n, y, yy = h[..., None, :, :], g[..., None, :], *(np.asarray(v)[..., None] for v in (n, y, yy))
    centred = g - intercept[:, None] * h[..., 0]
    squares = yy - 2 * intercept * y + n * intercept**2
    inner = lower.mT @ h @ lower
    full = np.eye(p) + inner / s2[:, None, None]
    cover = np.linalg.inv(full)
    pull = (lower.mT @ centred[..., None])[..., 0]
    mean = (cover @ pull[..., None])[..., 0] / s2[:, None]
    value = -n * np.log(sigma) - 0.5 * (squares - (pull * mean).sum(axis=-1)) / s2 - 0.5 * np.linalg.slogdet(full)[1] - 0.5 * n * np.log(2 * np.pi)
    second = cover + mean[..., :, None] * mean[..., None, :]
    by_l = (centred[..., :, None] * mean[..., None, :] - h @ lower @ second) / s2[:, None, None]
    by_b = (y - n * intercept - (h[..., 0] * (lower @ mean[..., None])[..., 0]).sum(axis=-1)) / s2
    residual = squares - 2 * (pull * mean).sum(axis=-1) + (inner * second).sum(axis=(-2, -1))
    by_s = -n + residual / s2
    return value, np.concatenate([by_b[..., None], packed(by_l), by_s[..., None]], axis=-1), mean, cover


def log_prior(theta: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Standard normal intercept, half-normal(0, 1) standard deviations; value and gradient for every parameter set."""
    lower = unpacked(theta[:, 1 : 1 + p * (p + 1) // 2], p)
    gradient = np.zeros_like(theta)
    gradient[:, 0] = -theta[:, 0]
    gradient[:, 1 : 1 + p * (p + 1) // 2] = -packed(lower)
    return -0.5 * (theta[:, 0] ** 2 + (lower**2).sum(axis=(1, 2))), gradient


@dataclass
class Optimum:
    theta: np.ndarray
    value: float
    history: list[float]
    passes: int
    converged: bool
    change: float


def _bent(curvature: np.ndarray) -> np.ndarray:
    """``curvature`` with positive eigenvalues: far from a maximum it may bend the wrong way."""
    values, axes = np.linalg.eigh((curvature + curvature.T) / 2)
    return (axes * np.maximum(np.abs(values), LEAST_CURVATURE)) @ axes.T


def maximise(evaluate: Callable, theta: np.ndarray, tolerance: float, passes: int, moved: Callable) -> Optimum:
    """Newton ascent whose curvature comes from gradients around the point, quasi-Newton where a step is cut.

    ``evaluate(thetas)`` gives values and gradients of many parameter sets in one pass. Each
    pass tries a few lengths of the step and the points next to its end: a whole step
    that helps is taken with its new curvature, a shorter or longer one with a BFGS update.
    The search ends when the next step would change the parameters by less than
    ``tolerance`` as ``moved`` measures it.
    """
    d, near = len(theta), NEXT * np.eye(len(theta))

    def around(values: np.ndarray, gradients: np.ndarray) -> np.ndarray:
        return _bent(-(gradients[1:] - gradients[0]) / NEXT)

    values, gradients = evaluate(np.concatenate([theta[None], theta + near]))
    value, gradient, curvature = values[0], gradients[0], around(values, gradients)
    history, used, change, lengths = [float(value)], 1, np.inf, LENGTHS
    while used < passes:
        step = np.linalg.solve(curvature, gradient)
        step *= min(1.0, LONGEST / max(np.abs(step).max(), 1e-300))
        change = moved(theta, theta + step)
        if change < tolerance:
            return Optimum(theta, float(value), history, used, True, change)
        tried = theta + np.array(lengths)[:, None] * step
        values, gradients = evaluate(np.concatenate([tried, tried[0] + near]))
        used += 1
        n = len(tried)
        best = int(np.where(np.isfinite(values[:n]), values[:n], -np.inf).argmax())
        if not values[best] > value:
            if lengths[0] < 1e-6:  # nothing helps along this step: the value is flat to rounding
                break
            lengths = tuple(x * 0.02 for x in lengths)
            continue
        # The whole step is as good as another that gains little more, and comes with its curvature.
        if values[0] - value > 0.5 * (values[best] - value):
            best, curvature = 0, around(values[[0, *range(n, n + d)]], gradients[[0, *range(n, n + d)]])
        else:
            s, y = tried[best] - theta, gradient - gradients[best]
            along = curvature @ s
            if s @ y > 1e-10 * np.linalg.norm(s) * np.linalg.norm(y):
                curvature = curvature - np.outer(along, along) / (s @ along) + np.outer(y, y) / (s @ y)
        theta, value, gradient, lengths = tried[best], values[best], gradients[best], LENGTHS
        history.append(float(value))
    return Optimum(theta, float(value), history, used, change < tolerance, change)


def information(evaluate: Callable, theta: np.ndarray, step: float = 1e-4) -> np.ndarray:
    """Negative second derivatives at ``theta``, from gradients on both sides; one pass."""
    d = len(theta)
    moves = np.concatenate([np.eye(d), -np.eye(d)]) * step
    gradients = evaluate(theta + moves)[1]
    found = -(gradients[:d] - gradients[d:]) / (2 * step)
    return (found + found.T) / 2
