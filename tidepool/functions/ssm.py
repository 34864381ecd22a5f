"""State-space models of one multivariate series (time x features)."""

from __future__ import annotations

import numpy as np


def block_hankel(y: np.ndarray, rows: int, columns: int | None = None) -> np.ndarray:
    """``rows`` block rows of lagged samples, features within each block."""
    n, p = y.shape
    columns = columns or n - rows + 1
    return np.concatenate([y[i : i + columns].T for i in range(rows)])


class Subspace:
    """What all model orders share: the factored past and future of a series, computed once.

    ``weights``: ``cva`` (canonical variates: the future is whitened before its factors are taken) or ``sv`` (singular values as they are).
    """

    def __init__(self, y: np.ndarray, horizon: int, weights: str = "cva") -> None:
        if weights not in ("cva", "sv"):
            raise ValueError(f"no such weights: {weights}")
        self.p, self.i = y.shape[1], horizon
        h = block_hankel(y, 2 * horizon)
        self.r = np.linalg.qr((h / np.sqrt(h.shape[1])).T, mode="r").T
        past, future = self.r[: self.p * horizon], self.r[self.p * horizon :]
        self.cut = self.p * horizon
        self.projection = projection = self._project(future, past)
        self.shorter = self._project(self.r[self.p * (horizon + 1) :], self.r[: self.p * (horizon + 1)])
        weight = np.eye(len(future))
        if weights == "cva":
            weight = np.linalg.cholesky(future @ future.T + 1e-9 * np.trace(future @ future.T) / len(future) * weight)
        u, s, _ = np.linalg.svd(np.linalg.solve(weight, projection), full_matrices=False)
        self.u, self.s, self.weight = u, np.clip(s, 0, 1) if weights == "cva" else s, weight

    @staticmethod
    def _project(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a @ np.linalg.pinv(b) @ b

    def fit(self, order: int, stable: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``A, C, K, R`` of innovations form x' = A x + K e, y = C x + e; ``solved`` then says whether eigenvalues gave the Riccati equation's solution.

        ``stable``: ``A`` from the observability matrix moved up by one block with zeros below, which has no eigenvalue outside the unit circle.
        Orders beyond the projection's rank, as of a series whose samples come many times in a row, would be made of rounding: LinAlgError.
        """
        p, i = self.p, self.i
        if not self.s[order - 1] > 1e-10 * self.s[0]:
            raise np.linalg.LinAlgError(f"no order {order}")
        gamma = self.weight @ self.u[:, :order] * np.sqrt(self.s[:order])
        state = np.linalg.pinv(gamma) @ self.projection
        after = np.linalg.pinv(gamma[:-p]) @ self.shorter
        now = self.r[p * i : p * (i + 1)]
        if stable:
            moved = np.concatenate([gamma[p:], np.zeros((p, order))])
            ac = np.concatenate([np.linalg.pinv(gamma) @ moved, gamma[:p]])
        else:
            ac = np.concatenate([after, now]) @ np.linalg.pinv(state)
        a, c = ac[:order], ac[order:]
        rest = np.concatenate([after, now]) - ac @ state
        noise = rest @ rest.T
        parts = noise[:order, :order], noise[order:, order:], noise[:order, order:]
        found = steady(a, c, *parts)
        self.solved = found is not None
        k, r = found or gain(a, c, *parts)
        return a, c, k, r


def riccati(a: np.ndarray, g: np.ndarray, c: np.ndarray, cov: np.ndarray) -> np.ndarray | None:
    """``P`` = A P A' + (G - A P C') (cov - C P C')^-1 (G - A P C')', or None if an eigenvalue of its pencil lies on the unit circle.

    ``g`` is the covariance of the next state and the output, ``cov`` the output's own.
    """
    n = len(a)
    inner = np.linalg.pinv(cov)
    f = a - g @ inner @ c
    left = np.block([[f.T, np.zeros((n, n))], [-g @ inner @ g.T, np.eye(n)]])
    right = np.block([[np.eye(n), -c.T @ inner @ c], [np.zeros((n, n)), f]])
    try:
        values, v = np.linalg.eig(np.linalg.solve(right, left))
    except np.linalg.LinAlgError:
        return None
    size = np.abs(values)
    inside = np.flatnonzero(size < 1)
    if (np.abs(size - 1) <= 1e-9).any() or len(inside) != n:
        return None
    top, bottom = v[:n, inside], v[n:, inside]
    p = np.real(bottom @ np.linalg.pinv(top))
    return (p + p.T) / 2


def steady(a: np.ndarray, c: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Steady Kalman gain and innovation covariance from the states' own covariance; None where that, or the Riccati equation, has no solution."""
    if np.abs(np.linalg.eigvals(a)).max() >= 1 - 1e-9:
        return None
    spread, power = q, a
    for _ in range(60):  # twice as many terms of the sum over steps each time
        more = power @ spread @ power.T
        spread, power = spread + more, power @ power
        if np.abs(more).max() <= 1e-16 * np.abs(spread).max():
            break
    g, cov = a @ spread @ c.T + s, c @ spread @ c.T + r
    p = riccati(a, g, c, cov)
    if p is None:
        return None
    e = cov - c @ p @ c.T
    if not np.isfinite(e).all() or np.linalg.eigvalsh((e + e.T) / 2).min() <= 0:
        return None
    return (g - a @ p @ c.T) @ np.linalg.inv(e), e


def gain(a: np.ndarray, c: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Steady Kalman gain and innovation covariance: the Riccati recursion to its fixed point, or for ``steps`` steps, by doubling where it can be."""
    p = doubled(a, c, q, r, s, steps - 1)
    if p is not None:
        e = c @ p @ c.T + r
        try:
            return (a @ p @ c.T + s) @ np.linalg.inv(e), e
        except np.linalg.LinAlgError:
            pass
    p = q.copy()
    k, e = np.zeros((len(a), len(c))), r
    for _ in range(steps):
        e = c @ p @ c.T + r
        try:
            k_new = (a @ p @ c.T + s) @ np.linalg.inv(e)
        except np.linalg.LinAlgError:
            k_new = (a @ p @ c.T + s) @ np.linalg.pinv(e)
        p = a @ p @ a.T + q - k_new @ e @ k_new.T
        p = (p + p.T) / 2
        if np.abs(k_new - k).max() < 1e-10:
            break
        k = k_new
    return k, e


def doubled(a: np.ndarray, c: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray, steps: int) -> np.ndarray | None:
    """The states' covariance ``steps`` steps of the Riccati recursion after ``q``; None where ``r`` has no inverse, or rounding hides the steps.

    Any number of steps is ``P -> h + f P (1 + g P)^-1 f'``; twice as many follow from its ``f, g, h``, so powers of two are put together.
    """
    own = np.linalg.eigvalsh((r + r.T) / 2)
    if not own[0] > 1e-10 * own[-1]:
        return None
    one, inner = np.eye(len(a)), np.linalg.inv(r)
    f, g, h, p = a - s @ inner @ c, c.T @ inner @ c, q - s @ inner @ s.T, q
    try:
        with np.errstate(over="ignore", invalid="ignore"):
            while steps:
                if steps & 1:
                    p = h + f @ np.linalg.solve(one + p @ g, p) @ f.T
                    p = (p + p.T) / 2
                steps >>= 1
                if steps:
                    inverse = np.linalg.inv(one + h @ g)
                    after = inverse @ f
                    f, g, h = f @ after, g + f.T @ g @ after, h + f @ inverse @ h @ f.T
                    g, h = (g + g.T) / 2, (h + h.T) / 2
    except np.linalg.LinAlgError:
        return None
    return p if np.isfinite(p).all() else None


class InputSubspace:
    """The factored past and future of a series with inputs, shared by all model orders.

    One triangular factor of stacked inputs and outputs holds all that is needed. The future outputs are projected on the past along the future inputs (an
    oblique projection); its singular vectors, weighted by what future inputs leave, span the observability matrix.
    """

    def __init__(self, y: np.ndarray, u: np.ndarray, horizon: int) -> None:
        self.y, self.u, self.p, self.m, self.i = y, u, y.shape[1], u.shape[1], horizon
        h = np.concatenate([block_hankel(u, 2 * horizon), block_hankel(y, 2 * horizon)])
        self.r = np.linalg.qr((h / np.sqrt(h.shape[1])).T, mode="r").T
        past, inputs, future = self._parts(horizon)
        left = self._rest(inputs)
        self.oblique = future @ left @ np.linalg.pinv(past @ left) @ past
        self.vectors, self.s, _ = np.linalg.svd(self.oblique @ left, full_matrices=False)

    def _parts(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the past (inputs, then outputs), of the future inputs and the future outputs, from block ``at`` on."""
        m, p, blocks = self.m, self.p, 2 * self.i
        inputs, outputs = self.r[: m * blocks], self.r[m * blocks :]
        return np.concatenate([inputs[: m * at], outputs[: p * at]]), inputs[m * at :], outputs[p * at :]

    @staticmethod
    def _rest(rows: np.ndarray) -> np.ndarray:
        """What takes the span of ``rows`` out of rows."""
        return np.eye(rows.shape[1]) - np.linalg.pinv(rows) @ rows

    def fit(self, order: int) -> tuple[np.ndarray, ...] | None:
        """``A, B, C, D, K`` of x' = A x + B u + K e, y = C x + D u + e; None where A isn't stable, as what it does without noise then outgrows any number.

        A and C follow from the observability matrix; B and D, with the first state, are the least squares fit of what the system does without noise to
        the outputs; K from the covariance of what the regression of states and outputs on states and inputs leaves.
        """
        p, i = self.p, self.i
        gamma = self.vectors[:, :order] * np.sqrt(self.s[:order])
        a, c = np.linalg.pinv(gamma[:-p]) @ gamma[p:], gamma[:p]
        if not np.isfinite(a).all() or np.abs(np.linalg.eigvals(a)).max() > 1:
            return None
        b, d = self._inputs_of(a, c)
        past, inputs, future = self._parts(i)
        later, after, rest = self._parts(i + 1)
        known, known_after = np.concatenate([past, inputs]), np.concatenate([later, after])
        state = np.linalg.pinv(gamma) @ (future @ np.linalg.pinv(known) @ known)
        new = np.linalg.pinv(gamma[:-p]) @ (rest @ np.linalg.pinv(known_after) @ known_after)
        both, given = np.concatenate([new, future[:p]]), np.concatenate([state, inputs])
        left = both - both @ np.linalg.pinv(given) @ given
        noise = left @ left.T
        parts = noise[:order, :order], noise[order:, order:], noise[:order, order:]
        k = (steady(a, c, *parts) or gain(a, c, *parts))[0]
        return a, b, c, d, k

    def _inputs_of(self, a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m, p, t = len(a), self.m, self.p, len(self.y)
        columns = np.zeros((t, p, n + n * m + p * m))
        columns[:, :, n + n * m :] = (self.u[:, None, :, None] * np.eye(p)[:, None]).reshape(t, p, p * m)
        both, given = np.concatenate([np.eye(n), np.zeros((n, n * m))], axis=1), np.repeat(self.u, n, axis=1)
        at = np.tile(np.arange(n), m), np.arange(n, n + n * m)  # where each input meets each state
        for s in range(t):
            columns[s, :, : n + n * m] = c @ both
            both = a @ both
            both[at] += given[s]
        found = np.linalg.lstsq(columns.reshape(t * p, -1), self.y.ravel(), rcond=None)[0]
        return found[n : n + n * m].reshape(m, n).T, found[n + n * m :].reshape(m, p).T


def predicted(y: np.ndarray, u: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, k: np.ndarray) -> np.ndarray:
    """One-step predictions of a system with inputs."""
    x, out = np.zeros(len(a)), np.empty_like(y, dtype=float)
    for t, sample in enumerate(y):
        out[t] = c @ x + d @ u[t]
        x = a @ x + b @ u[t] + k @ (sample - out[t])
    return out


def kalman(y: np.ndarray, a: np.ndarray, c: np.ndarray, k: np.ndarray, x: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``states, predictions, next state``: one-step predictions; a sample with NaN doesn't update."""
    x = np.zeros(len(a)) if x is None else np.asarray(x, float)
    states, guesses = np.empty((len(y), len(a))), np.empty_like(y, dtype=float)
    for t, sample in enumerate(y):
        states[t], guesses[t] = x, c @ x
        x = a @ x if np.isnan(sample).any() else a @ x + k @ (sample - guesses[t])
    return states, guesses, x


def filtered(y: np.ndarray, a: np.ndarray, c: np.ndarray, k: np.ndarray) -> np.ndarray:
    """``kalman``'s predictions of complete samples, for many at once.

    The series is cut into stretches as long as they are many: all are filtered side by side from rest, then each one's first state, which
    follows from the stretch before, is carried through it.
    """
    t, n = len(y), len(a)
    length = max(int(np.sqrt(t)), 1)
    parts = -(-t // length)
    given = np.zeros((parts * length, y.shape[1]))
    given[:t] = y
    driven = (given @ k.T).reshape(parts, length, n)
    step = (a - k @ c).T
    x, power = np.zeros((parts, length + 1, n)), np.empty((length + 1, n, n))
    power[0] = np.eye(n)
    for i in range(length):
        x[:, i + 1] = x[:, i] @ step + driven[:, i]
        power[i + 1] = power[i] @ step
    first = np.zeros((parts, n))
    for j in range(1, parts):
        first[j] = first[j - 1] @ power[length] + x[j - 1, length]
    states = x[:, :length] + (first @ power[:length].transpose(1, 0, 2).reshape(n, -1)).reshape(parts, length, n)
    return states.reshape(-1, n)[:t] @ c.T


def aic(y: np.ndarray, guesses: np.ndarray, parameters: int) -> float:
    """n x the log determinant of the residuals' covariance, and twice the parameters; infinite where predictions, or their squares, outgrow any number, or leave nothing of the samples in the residuals' digits."""
    known = ~np.isnan(y).any(1)
    y = y[known]
    e = y - guesses[known]
    with np.errstate(over="ignore", invalid="ignore"):
        outgrown = not np.isfinite(e.T @ e).all()
    if outgrown or (len(e) and np.finfo(float).eps * np.abs(e).max() > np.abs(y).max()):
        return float("inf")
    s = np.linalg.svd(e / np.sqrt(max(len(e), 1)), compute_uv=False)
    return float(2 * len(e) * np.log(np.maximum(s, 1e-150)).sum() + 2 * parameters)


def best_order(y: np.ndarray, shared: Subspace, orders: range, stable: bool = False) -> tuple[int, list[float]]:
    """The order with the least AIC and the values of all, of models that ``shared`` gives; infinite for one that can't be solved or whose predictions outgrow any number."""
    values = []
    for n in orders:
        try:
            a, c, k, _ = shared.fit(n, stable)
        except np.linalg.LinAlgError:
            values.append(float("inf"))
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            values.append(aic(y, filtered(y, a, c, k), (2 * y.shape[1] + 1) * n))
    return orders[int(np.argmin(values))], values
