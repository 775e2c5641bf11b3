"""Minimum-cost assignment of rows to columns by shortest augmenting paths (Crouse, IEEE TAES 52(4), 2016)."""

from __future__ import annotations

import math

import numpy as np


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """min(rows, columns) pairs of least total cost, in row order."""
    return solved(cost)[:2]


def solved(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs, and potentials of rows and of columns that prove them: no pair costs less than the sum of its two potentials, a chosen pair
    costs just that, and of the longer side no potential is above 0 and those without a partner are 0. So no choice of as many pairs is cheaper."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return np.empty(0, int), np.empty(0, int), np.zeros(cost.shape[0]), np.zeros(cost.shape[1] if cost.ndim > 1 else 0)
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        # grow a tree of shortest reduced paths from this row until it reaches a free column
        best, came = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        i, base, inside = row, 0.0, [row]
        while True:
            through = base + c[i] - u[i] - v
            better = ~done & (through < best)
            best[better], came[better] = through[better], i
            j = int(np.argmin(np.where(done, np.inf, best)))
            base = best[j]
            done[j] = True
            if owner[j] < 0:
                break
            i = owner[j]
            inside.append(i)
        # potentials of what the tree holds, then the path is turned over
        u[row] += base
        for k in np.flatnonzero(done):
            if k != j:
                u[owner[k]] += base - best[k]
            v[k] -= base - best[k]
        while True:
            i = came[j]
            owner[j], j = i, int(np.flatnonzero(owner == i)[0]) if i != row else -1
            if i == row:
                break
    columns = np.flatnonzero(owner >= 0)
    rows, columns = (columns, owner[columns]) if turned else (owner[columns], columns)
    order = np.argsort(rows)
    return rows[order], columns[order], *((v, u) if turned else (u, v))


def preferred(cost: np.ndarray, i: np.ndarray, j: np.ndarray, u: np.ndarray, v: np.ndarray, none: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of all matchings that cost as little as solved()'s, one that does not depend on the way there; and whether there was more than one.

    The first row has the earliest column that it can, later rows the latest ones, the last row before others; a cost of `none` is no match and comes
    after all columns. All cheapest matchings lie in the pairs that cost what their potentials sum up to, and leave out only what has a potential of
    0, so the choice is an assignment over these pairs alone. It holds where its total is not above that of the first in double precision.
    """
    n, m = cost.shape
    near = 16 * np.finfo(float).eps * max(1.0, *(float(np.abs(a).max()) for a in (u, v, np.where(cost < none, cost, 0))))
    tight = cost - u[:, None] - v[None, :] <= near
    real = cost < none
    mine = real[i, j]
    if np.count_nonzero(tight & real) == np.count_nonzero(mine):
        return i, j, False
    weight = 1.0 - 2 * np.arange(n)
    second = weight[:, None] * np.where(real, np.arange(m)[None, :] - m, 0)
    far = 4.0 * n * n * (m + 1)
    second = np.where(tight, second, far * 2 * (n + 1))
    # what has a potential is part of every cheapest matching
    second = second - far * (v < -near)[None, :] if n <= m else second - far * (u < -near)[:, None]
    k, at = assign(second)
    if not tight[k, at].all() or math.fsum(cost[k, at]) > math.fsum(cost[i, j]):
        return i, j, True
    return k, at, True


def latest(cost: np.ndarray, points: np.ndarray, none: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """The cheapest matching of one or two rows to columns, which are points; and whether another one that costs the same leads elsewhere.

    Of those whose sums are the same in double precision the last row has the latest column that it can, then the row before it; a cost of `none`
    is no match and comes before all columns. That is the order in which a query that joins all pairs meets them on one thread.
    """
    cost, m = np.asarray(cost, float), cost.shape[1]
    taken, costs = [], []
    for c in cost:
        # a dearer column than the second cheapest leaves a cheaper one free; of columns at one place the last two are enough
        limit = np.partition(np.append(c, [none, none]), 1)[1]
        k = np.flatnonzero((c < none) & (c <= limit + 16 * np.finfo(float).eps * none))
        if len(k) > 2:
            place = np.unique(points[k], axis=0, return_inverse=True)[1].ravel()
            order = np.lexsort((-k, place))
            more = np.zeros(len(k), bool)
            more[2:] = place[order][2:] == place[order][:-2]
            k = k[order][~more]
        taken.append(np.append(k, m))
        costs.append(np.append(c[k], none))
    if len(cost) == 1:
        taken, costs = [np.array([m]), *taken], [np.zeros(1), *costs]
    total = costs[0][:, None] + costs[1][None, :]
    total[(taken[0][:, None] == taken[1][None, :]) & (taken[0] < m)[:, None]] = np.inf
    p, q = np.nonzero(total == total.min())
    a, b = taken[0][p], taken[1][q]
    best = np.lexsort((a, b))[-1]
    to = np.vstack([points, np.full((1, 2), np.inf)])
    tied = len(a) > 1 and bool((to[a] != to[a[best]]).any() or (to[b] != to[b[best]]).any())
    found = [int(k[best]) for k in (a, b)][-len(cost) :]
    # what has no match has one of the columns left, so that there are as many pairs as there can be
    left = (k for k in range(m) if k not in found)
    found = [k if k < m else next(left, m) for k in found]
    rows = np.array([i for i, k in enumerate(found) if k < m], int)
    return rows, np.array([found[i] for i in rows], int), tied
