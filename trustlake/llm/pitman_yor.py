"""Chinese-restaurant seatings of a hierarchical Pitman-Yor model, in numpy.

Customers of a restaurant who eat one dish are a *cell*: n customers at t tables.
Every table sends one customer to the parent's restaurant. What a cell has to do
with the rest of the model is only how many tables it has, so a Gibbs step takes
all its customers out and draws t anew, given the restaurant's other tables and the
parent's probability p of the dish:

    P(t) ~ S_d(n, t) * product over 1 <= i < t of (theta + d * (others + i)) * p

with generalised Stirling numbers S_d. Up to ``EXACT`` customers the draw is from
this distribution itself. Beyond, customers are seated one after the other (in runs
that grow by a tenth) as proposals of a Metropolis-Hastings chain with this target.
"""

from __future__ import annotations

import functools

import numpy as np

EXACT = 64


@functools.lru_cache(maxsize=64)
def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S_d(n, t) for n, t up to ``most``."""
    out = np.full((most + 1, most + 2), -np.inf)
    out[0, 0] = 0.0
    for n in range(most):
        t = np.arange(1, most + 1)
        with np.errstate(divide="ignore"):
            stay = out[n, 1:-1] + np.log(np.maximum(n - d * t, 0))
        out[n + 1, 1:-1] = np.logaddexp(out[n, :-2], stay)
    return out[:, :-1]


def draw(counts: np.ndarray, new: np.ndarray, more: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each cell, from the conditional above; ``new + more * i``: weight of a new table when the cell has i."""
    counts = counts.astype(np.int64)
    out = np.minimum(counts, 1)
    d = round(float(d), 6)
    table = stirling(d)
    for n in np.unique(counts[(counts > 1) & (counts <= EXACT)]).tolist():
        at = np.flatnonzero(counts == n)
        for lo in range(0, len(at), 2_000_000 // n + 1):
            k = at[lo : lo + 2_000_000 // n + 1]
            weight = np.log(new[k, None] + more[k, None] * np.arange(1, n) + 1e-300)
            log = table[n, 1 : n + 1] + np.concatenate([np.zeros((len(k), 1)), np.cumsum(weight, axis=1)], axis=1)
            share = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
            out[k] = 1 + (share < (rng.random(len(k)) * share[:, -1])[:, None]).sum(axis=1)
    big = np.flatnonzero(counts > EXACT)
    if len(big):
        out[big] = chain(counts[big], new[big], more[big], d, rng)
    return out


def weighed(counts: np.ndarray, new: np.ndarray, more: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables when customers arrive one after the other, and the log of what the arrivals' weights were divided by: target over proposal, up to a constant."""
    n, t = np.minimum(counts, 1).astype(np.int64), np.minimum(counts, 1).astype(np.int64)
    log = np.zeros(len(n))
    while True:
        live = np.flatnonzero(n < counts)
        if not len(live):
            return t, log
        step = np.minimum(counts[live] - n[live], np.maximum(1, n[live] // 10))
        fresh = new[live] + more[live] * t[live]
        norm = np.maximum(n[live] - d * t[live], 1e-9) + fresh
        log[live] += step * np.log(norm)
        t[live] += rng.binomial(step, np.clip(fresh / norm, 0, 1))
        n[live] += step


def chain(counts: np.ndarray, new: np.ndarray, more: np.ndarray, d: float, rng: np.random.Generator, steps: int = 4) -> np.ndarray:
    t, log = weighed(counts, new, more, d, rng)
    for _ in range(steps):
        other, its = weighed(counts, new, more, d, rng)
        take = np.log(rng.random(len(t)) + 1e-300) < its - log
        t, log = np.where(take, other, t), np.where(take, its, log)
    return t


def _log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift = shift - np.where(small, np.log(np.where(small, x, 1.0)), 0.0)
        x = np.where(small, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


D_GRID = np.round(np.arange(0.05, 0.96, 0.05), 2)
THETA_GRID = np.array([0.1, 0.3, 1, 3, 10, 30, 100, 300, 1000, 3000, 10_000.0])


def resample(customers: np.ndarray, tables: np.ndarray, cells: np.ndarray, d: float, theta: float, rng: np.random.Generator, more_customers: tuple = ((), ()), more_tables: tuple = ((), ())) -> tuple[float, float]:
    """Discount and strength, drawn together from their posterior on a grid (flat prior).

    Given are every restaurant's customers and tables, and the number of cells
    with n customers at t tables (n up to ``EXACT``; larger ones are left out).
    More restaurants may be given as counts: sizes, and how many have each.
    ``d`` and ``theta`` are returned as they are where nobody sits.
    """
    live = tables > 0
    if not live.any():
        return d, theta
    c, of_c = (np.append(x, y) for x, y in zip(np.unique(customers[live], return_counts=True), more_customers))
    t, of_t = (np.append(x, y) for x, y in zip(np.unique(tables[live], return_counts=True), more_tables))
    n, k = np.nonzero(cells)
    one = lambda x: _log_gamma(np.array([x]))[0]
    log = np.empty((len(D_GRID), len(THETA_GRID)))
    for j, y in enumerate(THETA_GRID.tolist()):
        log[:, j] = of_c.sum() * one(y + 1) - (of_c * _log_gamma(y + c)).sum()
        for i, x in enumerate(D_GRID.tolist()):
            log[i, j] += (of_t * ((t - 1) * np.log(x) + _log_gamma(y / x + t))).sum() - of_t.sum() * one(y / x + 1)
    for i, x in enumerate(D_GRID.tolist()):
        s = stirling(x)[n, k]
        log[i] += (cells[n, k] * s)[np.isfinite(s)].sum()
    i, j = np.unravel_index(np.argmax(log + rng.gumbel(size=log.shape)), log.shape)
    return float(D_GRID[i]), float(THETA_GRID[j])


def histogram(customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Cells with n customers at t tables, n and t up to ``EXACT``."""
    small = (customers > 0) & (customers <= EXACT)
    return np.bincount(customers[small].astype(np.int64) * (EXACT + 1) + tables[small].astype(np.int64), minlength=(EXACT + 1) ** 2).reshape(EXACT + 1, EXACT + 1)


class Level:
    """Cells of all restaurants of one depth. ``count``: customers, ``t``: tables."""

    def __init__(self, context: np.ndarray, dish: np.ndarray, contexts: int) -> None:
        self.context, self.dish, self.contexts = context, dish, contexts
        self.count = np.zeros(len(context), np.int64)
        self.t = np.zeros(len(context), np.int64)
        self.d, self.theta = 0.5, 1.0

    def serve(self, count: np.ndarray) -> None:
        self.count = count.astype(np.int64)
        self.t = np.clip(self.t, np.minimum(self.count, 1), self.count)
        self.customers = np.bincount(self.context, self.count, self.contexts)

    @property
    def total(self) -> np.ndarray:
        return np.bincount(self.context, self.t, self.contexts)

    def step(self, parent: np.ndarray, rng: np.random.Generator) -> None:
        """A Gibbs step of every cell, given the tables that the others had before it; then the level's parameters."""
        others = self.total[self.context] - self.t
        self.t = draw(self.count, (self.theta + self.d * others) * parent, self.d * parent, self.d, rng)
        self.d, self.theta = resample(self.customers, self.total, histogram(self.count, self.t), self.d, self.theta, rng)


class Hierarchy:
    """Levels from the full context (first) to the empty one (last), over a uniform base.

    ``parents[i]`` maps contexts of level i to those of level i + 1. Probabilities
    are dense: contexts x dishes of each level must be bounded.
    """

    def __init__(self, context: np.ndarray, dish: np.ndarray, count: np.ndarray, parents: list[np.ndarray], dishes: int, seed: int = 3) -> None:
        self.rng, self.parents, self.dishes = np.random.default_rng(seed), parents, dishes
        order = np.lexsort((dish, context))
        self.levels = [Level(context[order], dish[order], len(parents[0]) if parents else 1)]
        self.above: list[np.ndarray] = []
        for p in parents:
            top = self.levels[-1]
            u, back = np.unique(p[top.context].astype(np.int64) * dishes + top.dish, return_inverse=True)
            self.levels.append(Level(u // dishes, u % dishes, int(p.max(initial=0)) + 1))
            self.above.append(back)
        self.levels[0].serve(count[order])
        self._send()

    def _send(self) -> None:
        """Tables as customers of the level below."""
        for i, back in enumerate(self.above):
            self.levels[i + 1].serve(np.bincount(back, self.levels[i].t, len(self.levels[i + 1].count)))

    def dense(self, i: int) -> np.ndarray:
        """Predictive probabilities of level i: contexts x dishes."""
        if i == len(self.levels):
            return np.full((1, self.dishes), 1.0 / self.dishes)
        level = self.levels[i]
        low = self.dense(i + 1)
        norm = level.theta + level.customers
        up = self.parents[i] if i < len(self.parents) else np.zeros(level.contexts, np.int64)
        out = ((level.theta + level.d * level.total) / norm)[:, None].astype(np.float32) * low[up].astype(np.float32)
        out[level.context, level.dish] += ((level.count - level.d * level.t) / norm[level.context]).astype(np.float32)
        return out

    def sweep(self) -> None:
        """A Gibbs step of every level; tables that come or go are customers of the parent at once."""
        for i, level in enumerate(self.levels):
            up = self.parents[i][level.context] if i < len(self.parents) else np.zeros(len(level.context), np.int64)
            level.step(self.dense(i + 1)[up, level.dish].astype(np.float64), self.rng)
            self._send()

    def averaged(self, burn: int = 3, samples: int = 3) -> np.ndarray:
        """Predictive probabilities, averaged over seatings."""
        for _ in range(burn):
            self.sweep()
        total = 0.0
        for _ in range(samples):
            self.sweep()
            total = total + self.dense(0)
        return (total / samples).astype(np.float32)
