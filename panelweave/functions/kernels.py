"""NumPy helpers for one small matrix problem each.

Spark decides which problem runs where; a helper sees one K x K (or p x p)
problem, whose size is set by the number of assets and not by the data.
"""

from __future__ import annotations

import numpy as np

#: A sparse precision matrix has converged where no optimality condition is breached by more than this share of lam.
GAP = 1e-3


def soft(x, lam):
    """Soft threshold."""
    return np.sign(x) * np.maximum(np.abs(x) - lam, 0.0)


def symmetric(i, j, v):
    """Dense symmetric matrix from upper-triangle cells; returns (names, matrix)."""
    names, index = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = index[: len(i)], index[len(i):]
    out = np.zeros((len(names), len(names)))
    out[a, b] = v
    out[b, a] = v
    return names, out


def blocks(joined):
    """Index arrays of the connected components of a symmetric boolean matrix, by minima handed to neighbours."""
    label = np.arange(len(joined))
    near = joined | np.eye(len(joined), dtype=bool)
    while True:
        least = np.where(near, label, len(label)).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            return [np.flatnonzero(label == k) for k in np.unique(label)]
        label = least


def sparse_precision(s, lam, start=None, max_iter=2000, tol=1e-9):
    """Sparse inverse covariance: min -logdet(W) + tr(S W) + lam * sum of |W_ij|, i != j.

    Assets that no chain of |S_ij| > lam joins are apart in the optimum, so every component
    of that graph is solved on its own.  Returns the matrix, whose
    zeros are exact, the most iterations a component used and the largest violation of the
    optimality conditions of the whole relative to lam: above GAP the solve has not converged.
    """
    if lam <= 0:
        omega = np.linalg.inv(s)
        return (omega + omega.T) / 2, 0, optimality_gap(s, omega, lam)
    omega, most = np.zeros_like(s), 0
    for own in blocks(np.abs(s) > lam):
        cell = np.ix_(own, own)
        if len(own) == 1:
            omega[cell] = 1.0 / s[cell]
            continue
        omega[cell], used = solve_component(s[cell], lam, None if start is None else start[cell], max_iter, tol)
        most = max(most, used)
    return omega, most, optimality_gap(s, omega, lam)


def solve_component(s, lam, start, max_iter, tol):
    """One component: alternating directions, then Newton steps where those end with the conditions open.

    On the correlation scale (penalties rescaled to match), over-relaxed, with a spectral step for the
    log-determinant.  The weight of the constraint follows the ratio of the relative residuals: the
    matrices and the multipliers differ by orders of magnitude when the penalty is small.  Where neither
    meets GAP / 10, the directions go on to a hundredth of the residual, up to max_iter in all.
    """
    d = np.sqrt(np.diag(s))
    scale = np.outer(d, d)
    r, pen = s / scale, lam / scale
    np.fill_diagonal(pen, 0.0)
    z = np.eye(len(s)) if start is None else start * scale
    u, rho = np.zeros_like(z), 0.1
    for it in range(1, max_iter + 1):
        val, vec = np.linalg.eigh(rho * (z - u) - r)
        root = np.sqrt(val * val + 4 * rho)
        x = (vec * np.where(val < 0, 2 / (root - val), (val + root) / (2 * rho))) @ vec.T
        ahead = 1.6 * x - 0.6 * z
        before, z = z, soft(ahead + u, pen / rho)
        u += ahead - z
        primal = np.linalg.norm(x - z) / max(np.linalg.norm(x), np.linalg.norm(z))
        dual = np.linalg.norm(z - before) / max(np.linalg.norm(u), 1e-300)
        if it % 10 == 0:
            factor = min(max(np.sqrt(primal / max(dual, 1e-300)), 0.2), 5.0)
            if not 2 / 3 < factor < 1.5:
                rho, u = rho * factor, u / factor
        if max(primal, dual) > tol and it < max_iter:
            continue
        found, steps, gap = z, 0, optimality_gap(s, z / scale, lam)
        if not gap <= GAP / 10:
            begin = z if np.isfinite(gap) else np.eye(len(s))
            better, steps = newton_precision(r, pen, begin, lambda m: optimality_gap(s, m / scale, lam))
            after = optimality_gap(s, better / scale, lam)
            if after < gap:
                found, gap = better, after
        if gap <= GAP / 10 or it == max_iter or tol < 1e-14:
            return found / scale, it + steps
        tol /= 100


def newton_precision(r, pen, z, gap_of, steps=50, inner=300):
    """Newton steps for -logdet(Z) + tr(R Z) + sum of pen |Z_ij| inside the orthant of the signs.

    Free cells are the non-zero ones and the zeros whose condition is breached; a cell
    that would change its sign becomes zero.  The direction comes from conjugate gradients on the free
    cells, which only need products W D W with the inverse W, so no system of the cells is ever
    formed.  Stops with the gap below GAP / 10 or without a step that lessens the objective.
    """
    diagonal = np.eye(len(z), dtype=bool)

    def objective(m):
        try:
            return np.sum(r * m) + np.sum(pen * np.abs(m)) - 2 * np.log(np.diag(np.linalg.cholesky(m))).sum()
        except np.linalg.LinAlgError:
            return np.inf

    def direction(w, slope, free):
        ease = 1.0 / (np.outer(np.diag(w), np.diag(w)) + w * w)
        move, left = np.zeros_like(w), -slope
        eased = left * ease
        way, size = eased, np.sum(left * eased)
        first = size
        for _ in range(inner):
            curved = np.where(free, w @ way @ w, 0.0)
            length = size / np.sum(way * curved)
            move, left = move + length * way, left - length * curved
            eased = left * ease
            before, size = size, np.sum(left * eased)
            if size <= 1e-12 * first:
                break
            way = eased + size / before * way
        return move

    value = objective(z)
    for step in range(steps):
        if gap_of(z) <= GAP / 10:
            return z, step
        w = np.linalg.inv(z)
        w = (w + w.T) / 2
        sign = np.where(z != 0, np.sign(z), np.where(np.abs(w - r) > pen, np.sign(w - r), 0.0))
        free = (sign != 0) | diagonal
        move, length = direction(w, np.where(free, r - w + pen * sign, 0.0), free), 1.0
        while length > 1e-12:
            tried = z + length * move
            tried[(tried * sign <= 0) & ~diagonal] = 0.0
            new = objective(tried)
            if new < value:
                break
            length /= 2
        else:
            return z, step
        z, value = tried, new
    return z, steps


def optimality_gap(s, omega, lam):
    """Largest breach of the stationarity conditions, relative to lam (or to the diagonal)."""
    if np.linalg.eigvalsh(omega)[0] <= 0:
        return float("inf")
    g = np.linalg.inv(omega) - s
    off = ~np.eye(len(s), dtype=bool)
    on = (omega != 0) & off
    gaps = [np.abs(np.diag(g)).max(initial=0.0),
            np.abs(g - lam * np.sign(omega))[on].max(initial=0.0),
            (np.abs(g)[off & ~on] - lam).max(initial=0.0)]
    return max(gaps) / (lam or np.diag(s).mean())


def min_variance(s):
    """Weights proportional to S^-1 1, summing to 1."""
    x = np.linalg.solve(s, np.ones(len(s)))
    return x / x.sum()


def least_squares(gram, cross, rcond=1e-10):
    """Shortest solution of gram @ b = cross; shares that sum to 1 make the Gram matrix singular."""
    val, vec = np.linalg.eigh(gram)
    keep = val > rcond * val[-1]
    return vec[:, keep] @ ((vec[:, keep].T @ cross) / val[keep, None])


def weighted_lasso(gram, cross, pen, beta, tol=1e-10, max_sweeps=1000):
    """Coordinate descent for several equations that share one Gram matrix.

    Minimises b'Gb/2 - c'b + sum pen|b| for every column of `cross`.  Sweeps
    alternate between all coordinates and those in use until neither moves.
    """
    return solve_lasso(gram, cross, pen, beta, tol, max_sweeps)[0]


def solve_lasso(gram, cross, pen, beta, tol=1e-10, max_sweeps=1000, before=None, exact=500):
    """As weighted_lasso, with whether it converged.  What max_sweeps leaves open is ended by at most `exact` exact steps.

    Only a working set of rows is swept, on its own part of the Gram matrix: those in use and those that the
    sequential strong rule cannot leave out, given the penalties `before` that `beta` solves (None: those
    that breach their condition).  Then the conditions of all rows are checked, and rows that
    breach theirs join, until none does; so the rule can never lose one.
    """
    diag = np.diag(gram)
    usable = diag > 1e-12
    root = np.sqrt(np.where(usable, diag, 1.0))
    used = np.flatnonzero((beta != 0).any(axis=1))
    resid = cross - gram[:, used] @ beta[used]
    bound = pen if before is None else np.clip(2 * pen - before, 0.0, pen)
    work = usable & ((beta != 0).any(axis=1) | (np.abs(resid) > bound).any(axis=1))
    left = max_sweeps
    while True:
        rows = np.flatnonzero(work)
        own, left, settled = _sweeps(gram[np.ix_(rows, rows)], resid[rows], pen[rows], beta[rows], tol, left)
        beta[rows] = own
        used = np.flatnonzero((beta != 0).any(axis=1))
        resid = cross - gram[:, used] @ beta[used]
        if not settled:
            ends = [_active_set(gram, cross[:, e], pen[:, e], beta[:, e], usable, exact) for e in range(beta.shape[1])]
            return np.column_stack([b for b, _ in ends]), all(done for _, done in ends)
        breach = usable & ~work & ((np.abs(resid) - pen).max(axis=1) > tol * root)
        if not breach.any():
            return beta, True
        work |= breach


def _active_set(gram, cross, pen, beta, usable, steps=500, tol=1e-9):
    """One equation from near its optimum, by exact steps on the coefficients in use.

    Their signs give a linear system; on the way to its solution the first coefficient that would change its
    sign leaves, and at the solution the zeros that breach their condition most join.  Small penalties, for
    which sweeps creep, need few such steps.  Second value: whether all conditions hold.
    """
    beta, sign = beta.copy(), np.sign(beta)
    inside = (beta != 0) | (usable & (pen == 0))
    for _ in range(steps):
        at = np.flatnonzero(inside)
        try:
            goal = np.linalg.solve(gram[np.ix_(at, at)], cross[at] - pen[at] * sign[at])
        except np.linalg.LinAlgError:
            return beta, False
        turned = (goal * sign[at] < 0) & (pen[at] > 0)
        if turned.any():
            share = beta[at] / np.where(turned, beta[at] - goal, 1.0)
            share = np.where(turned, share, np.inf)
            first = int(np.argmin(share))
            beta[at] += max(share[first], 0.0) * (goal - beta[at])
            beta[at[first]] = sign[at[first]] = 0.0
            inside[at[first]] = False
            continue
        beta[:] = 0.0
        beta[at] = goal
        resid = cross - gram[:, at] @ goal
        over = np.where(inside | ~usable, -np.inf, np.abs(resid) - pen)
        if over.max(initial=-np.inf) <= tol * np.sqrt(np.diag(gram)).max():
            return beta, True
        join = int(np.argmax(over))
        inside[join], sign[join] = True, np.sign(resid[join])
    return beta, False


def _sweeps(gram, resid, pen, beta, tol, left):
    """Coordinate descent on the rows given: all of them, then those in use until they rest, and again."""
    resid, beta = resid.copy(), beta.copy()
    diag, every = np.diag(gram), np.arange(len(gram))
    active = every
    while left > 0:
        left, full, moved = left - 1, active is every, 0.0
        for j in active:
            new = soft(resid[j] + diag[j] * beta[j], pen[j]) / diag[j]
            step = new - beta[j]
            top = np.abs(step).max()
            if top > 0:
                resid -= np.outer(gram[:, j], step)
                beta[j] = new
                moved = max(moved, top * np.sqrt(diag[j]))
        if moved <= tol:
            if full:
                return beta, left, True
            active = every
        elif full:
            active = np.flatnonzero((beta != 0).any(axis=1))
    return beta, 0, len(every) == 0


def recurrent_forward(seq, gates, out, temperature=0.5, bound=50.0):
    """One recurrent layer over a batch of sequences, softmax shares at the end.

    `seq` is (batch, steps, features); `gates` maps f, i, o, c to (matrix,
    bias) acting on [features, hidden]; `out` is the output (matrix, bias).
    """
    def squash(a):
        return 1.0 / (1.0 + np.exp(-np.clip(a, -bound, bound)))

    hidden = len(gates["f"][1])
    state = np.zeros((len(seq), hidden))
    memory = np.zeros((len(seq), hidden))
    for step in range(seq.shape[1]):
        joined = np.concatenate([seq[:, step], state], axis=1)
        act = {g: joined @ m.T + b for g, (m, b) in gates.items()}
        memory = squash(act["f"]) * memory + squash(act["i"]) * np.tanh(act["c"])
        state = squash(act["o"]) * np.tanh(memory)
    score = (state @ out[0].T + out[1]) / temperature
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return score / score.sum(axis=1, keepdims=True)
