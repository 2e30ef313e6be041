"""Least-squares fits of series from sums of products of lags, which ranges of a series give each for itself.

A run is the rows of one entity in one range of steps, with some rows before it (see ranges.with_halo). No function here
needs more of a series than a run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from panelspark.operators.kernels import ADF_5


def lagged(v: np.ndarray, lags: int, start: int) -> np.ndarray:
    """Rows t >= start of 1, v[t], v[t - 1], ..., v[t - lags]."""
    t = np.arange(start, len(v))
    return np.column_stack([np.ones(len(t)), v[t[:, None] - np.arange(lags + 1)]]) if len(t) else np.zeros((0, lags + 2))


def solve(g: np.ndarray, k: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients of the last column of a Gram matrix on the first k, the residual sum of squares, and the inverse."""
    scale = 1 / np.sqrt(np.maximum(np.diag(g)[:k], 1e-300))
    inverse = np.linalg.pinv(g[:k, :k] * np.outer(scale, scale), rcond=1e-13, hermitian=True) * np.outer(scale, scale)
    beta = inverse @ g[:k, -1]
    return beta, max(float(g[-1, -1] - beta @ g[:k, -1]), 0.0), inverse


# --- unit roots ---------------------------------------------------------------------------------------------------


def adf_lags(n: int) -> int:
    """Most lagged differences that the test tries for a series of n values."""
    return max(min(int(12 * (n / 100) ** 0.25), n // 2 - 3), 0)


def adf_rows(v: np.ndarray, lags: int, start: int) -> np.ndarray:
    """For each difference d[i] with i >= start: 1, the level before, `lags` differences before, and the difference itself."""
    d = np.diff(v)
    i = np.arange(start, len(d))
    return np.column_stack([np.ones(len(i)), v[i], d[i[:, None] - 1 - np.arange(lags)], d[i]]) if len(i) else np.zeros((0, lags + 3))


def adf_sums(y: np.ndarray, first: int, n: int) -> list[np.ndarray]:
    """Of a run whose own rows begin at `first`: for 0, 1 and 2 differences the Gram matrix of its own rows, and the least
    and the largest value among them and the row before. n: length of the whole series."""
    out = []
    for k in range(3):
        lags, v = adf_lags(n - k), np.diff(y, k)
        z = adf_rows(v, lags, max(lags, first - 1 - k))
        own = v[max(first - k - 1, 0) :]
        out += [z.T @ z, np.array([own.min(initial=np.inf), own.max(initial=-np.inf)])]
    return out


def adf_verdict(g: np.ndarray, head: np.ndarray, spread: float, n: int) -> tuple[float, bool]:
    """(tau, rejected) from the whole series' Gram matrix of all lags, its first values and its range, as kernels.adf."""
    if n < 10 or spread == 0:
        return math.nan, spread == 0 and n >= 10
    most = adf_lags(n)
    rows = n - 1 - most
    best = None
    for k in range(most + 1):
        keep = [*range(k + 2), most + 2]
        _, ssr, _ = solve(g[np.ix_(keep, keep)], k + 2)
        ssr = ssr if ssr > 1e-14 * g[-1, -1] else 0.0
        aic = rows * math.log(max(ssr, 1e-300) / rows) + 2 * (k + 2)
        if best is None or aic < best[0]:
            best = (aic, k)
    k = best[1]
    keep = [*range(k + 2), most + 2]
    extra = adf_rows(head[: most + 1], k, k)  # rows that fewer lags have besides
    beta, ssr, inverse = solve(g[np.ix_(keep, keep)] + extra.T @ extra, k + 2)
    t = n - 1 - k
    se = math.sqrt(max(inverse[1, 1] * ssr / max(t - k - 2, 1), 0.0))
    tau = float(beta[1] / se) if se > 0 else -math.inf
    return tau, tau < sum(b / t**i for i, b in enumerate(ADF_5))


# --- orders -------------------------------------------------------------------------------------------------------


def long_lags(p: int, q: int, n: int) -> int:
    """Lags of the autoregression that gives the shocks of an order with q > 0."""
    return min(max(p + q, int(round(math.log(max(n, 2)) ** 1.5))), n // 3) if q else 0


def order_lags(orders: list[tuple[int, int]], n: int) -> int:
    """Lags that the Gram matrix for all of the orders needs."""
    return max(max(p, long_lags(p, q, n) + q) for p, q in orders)


class Orders:
    """Fits of all orders (p, q) to one series from one Gram matrix of its lags and its first values.

    g: sums over t >= lags of the products of 1, w[t], ..., w[t - lags]; head: w[:lags]; n: the series' length. Pure
    autoregressions are done at once. For mixed orders the shocks are combinations of lags, so the second regression of
    Hannan and Rissanen, too, is a congruence of g; what is left is the residuals' recursion (see Filtered).
    """

    def __init__(self, g: np.ndarray, head: np.ndarray, n: int):
        self.g, self.head, self.n, self.lags = g, head, n, len(g) - 2
        self.from_start: dict[int, np.ndarray] = {}

    def gram(self, start: int) -> np.ndarray:
        """g with the rows from `start` on; lags that a row lacks are not asked for."""
        if start not in self.from_start:
            rows = np.zeros((max(min(self.lags, len(self.head)) - start, 0), self.lags + 2))
            for i, t in enumerate(range(start, min(self.lags, len(self.head)))):
                rows[i, 0] = 1
                rows[i, 1 : t + 2] = self.head[t::-1]
            self.from_start[start] = self.g + rows.T @ rows
        return self.from_start[start]

    def fit(self, p: int, q: int) -> tuple[float, np.ndarray, np.ndarray, int, float]:
        """(constant, phi, theta, first residual, sum of squares); the last is right only where q is 0."""
        m = long_lags(p, q, self.n)
        s = max(p, m + q)
        if self.n - s < p + q + 2:
            raise ValueError("too short")
        unit = np.eye(self.lags + 2)
        columns = [unit[0], *unit[2 : 2 + p]]
        if q:
            keep = [0, *range(2, 2 + m), 1]
            beta, _, _ = solve(self.gram(m)[np.ix_(keep, keep)], m + 1)
            for j in range(1, q + 1):
                shock = np.zeros(self.lags + 2)
                shock[0] = -beta[0]
                shock[1 + j] = 1
                shock[2 + j : 2 + j + m] -= beta[1:]
                columns.append(shock)
        t = np.column_stack([*columns, unit[1]])
        beta, ssr, _ = solve(t.T @ self.gram(s) @ t, p + q + 1)
        phi, theta = beta[1 : p + 1], beta[p + 1 :]
        if q:
            largest = np.abs(np.roots(np.append(1.0, theta))).max(initial=0)
            if largest >= 0.999:
                theta = theta * 0.9 / largest
        return float(beta[0]), phi, theta, s, ssr


def information(variance: float, n: int, p: int, q: int) -> float:
    return n * (math.log(2 * math.pi * max(variance, 1e-12)) + 1) + 2 * (p + q + 2)


def packed(p: int, s: int, c: float, phi: np.ndarray, theta: np.ndarray, most_p: int, most_q: int) -> np.ndarray:
    """A fit as numbers: p, first residual, constant, most_p phis and most_q thetas."""
    return np.concatenate([[p, s, c], np.pad(phi, (0, most_p - len(phi))), np.pad(theta, (0, most_q - len(theta)))])


def filtered(w: np.ndarray, first: int, fits: np.ndarray, most_p: int) -> tuple[np.ndarray, np.ndarray]:
    """What a run's own values w[first:] do to the residuals of several fits, whatever the residuals before were.

    Residuals obey e[t] = w[t] - c - phi w - theta e, and are 0 before t = p. So those of a run, and their sum of squares
    from the first that counts on, are a linear and a quadratic form of (1, the last q residuals before it): gives
    (fits, q + 1, q + 1) matrices `step` and `squares`. Runs combine by `chained`. The recursion goes through all pieces of a
    run at once, and the pieces are chained.
    """
    q = fits.shape[1] - 3 - most_p
    k = q + 1
    t = np.arange(first, len(w))
    n, count = len(t), len(fits)
    p, s, c = fits[:, 0, None], fits[:, 1, None], fits[:, 2, None]
    phi, theta = fits[:, 3 : 3 + most_p], fits[:, 3 + most_p :]
    u = w[t][None] - c
    for j in range(most_p):
        u = u - phi[:, j, None] * np.where(t - 1 - j >= 0, w[np.maximum(t - 1 - j, 0)], 0.0)[None]
    exists, counts = t[None] >= p, t[None] >= s
    size = max(64, math.isqrt(n))
    pieces = -(-n // size)
    pad = pieces * size - n
    u, exists, counts = (np.pad(x, ((0, 0), (0, pad))).reshape(count, pieces, size) for x in (u, exists, counts))
    inside = np.pad(np.ones(n, bool), (0, pad)).reshape(pieces, size)
    state = np.zeros((count, pieces, k, q))
    state[:, :, 1:] = np.eye(q)
    squares = np.zeros((count, pieces, k, k))
    for i in range(size):
        e = -np.einsum("cpkj,cj->cpk", state, theta)
        e[:, :, 0] += u[:, :, i]
        e *= exists[:, :, i, None]
        squares += (e[..., :, None] * e[..., None, :]) * counts[:, :, i, None, None]
        moved = np.concatenate([e[..., None], state[..., :-1]], axis=-1)
        state = np.where(inside[None, :, i, None, None], moved, state)
    step = np.zeros((count, pieces, k, k))
    step[:, :, 0, 0] = 1
    step[:, :, :, 1:] = state
    total = (step[:, 0], squares[:, 0]) if pieces else (np.broadcast_to(np.eye(k), (count, k, k)), np.zeros((count, k, k)))
    for j in range(1, pieces):
        total = chained(total, (step[:, j], squares[:, j]))
    return total


def chained(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two neighbouring runs as one."""
    return a[0] @ b[0], a[1] + a[0] @ b[1] @ np.swapaxes(a[0], -1, -2)


# --- walk-forward ---------------------------------------------------------------------------------------------------


def walk(y: np.ndarray, first: int, offset: int, n: int, prefix: np.ndarray | None, p: int, d: int, share: float, window: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forecasts of a run's own rows, each from the autoregression fitted on all rows before its origin.

    y: the run with rows before it; first: where its own rows begin; offset: how many rows of the series come before
    y[0]; prefix: sums of lag products over the rows before the own ones, in the differenced series. Origins are
    floor(share n) and every `window` rows on. Gives places in y, predictions, and whether they come from a fit (else
    they persist). Normal equations are running sums; each origin solves its own.
    """
    begin = math.floor(n * Fraction(str(share)))  # as functions.scalars.whole_share
    w = np.diff(y, d)
    target = np.arange(max(first, begin - offset), len(y))
    if not len(target):
        return target, np.zeros(0), np.zeros(0, bool)
    origin = begin + (target + offset - begin) // window * window - offset  # rows before it are known
    origins = np.unique(origin)
    # cumulative sums over rows t of w (w[t] is made of y[t : t + d + 1]), as of the first origin
    g = np.zeros((p + 2, p + 2)) if prefix is None else prefix.copy()
    at = max(first - d, p)  # rows before this place are in the prefix
    low = origins[0] - d
    if low < at:
        z = lagged(w[: min(at, len(w))], p, max(low, p))
        g -= z.T @ z
    else:
        z = lagged(w[:low], p, at)
        g += z.T @ z
    grams = np.empty((len(origins), p + 2, p + 2))
    done, last = 0, low
    while done < len(origins):
        part = origins[done : done + block] - d
        z = lagged(w[: part[-1]], p, max(last, p))
        sums = np.cumsum(z[:, :, None] * z[:, None, :], axis=0)
        upto = np.maximum(part - max(last, p), 0)
        grams[done : done + block] = g + np.where((upto > 0)[:, None, None], sums[np.maximum(upto - 1, 0)] if len(sums) else 0.0, 0.0)
        g, last, done = grams[done + len(part) - 1], part[-1], done + len(part)
    keep = [0, *range(2, p + 2), 1]
    grams = grams[:, keep][:, :, keep]
    finite = np.isfinite(grams).all((1, 2))
    grams = np.where(finite[:, None, None], grams, 0.0)
    scale = 1 / np.sqrt(np.maximum(np.einsum("oii->oi", grams)[:, : p + 1], 1e-300))
    both = scale[:, :, None] * scale[:, None, :]
    beta = np.einsum("oij,oj->oi", np.linalg.pinv(grams[:, : p + 1, : p + 1] * both, rcond=1e-13, hermitian=True) * both, grams[:, : p + 1, -1])
    known = origins + offset - d - p  # rows that the fit has
    fits = finite & (known >= p + 2)
    past = [np.where(origins - d - 1 - j >= 0, w[np.maximum(origins - d - 1 - j, 0)], 0.0) for j in range(max(p, 1))]
    levels = [np.where(origins - 1 >= j, np.diff(y, j)[np.clip(origins - 1 - j, 0, len(y) - 1 - j)], 0.0) for j in range(d)]
    ahead = np.empty((len(origins), window))
    for h in range(window):
        v = beta[:, 0] + sum((beta[:, 1 + j] * past[j] for j in range(p)), np.zeros(len(origins)))
        past = [v, *past[:-1]]
        for j in range(d - 1, -1, -1):
            levels[j] = v = levels[j] + v
        ahead[:, h] = v
    k = np.searchsorted(origins, origin)
    ok = fits[k]
    return target, np.where(ok, ahead[k, target - origin], y[np.maximum(origin - 1, 0)]), ok


# --- forecasts ----------------------------------------------------------------------------------------------------


def forecast_many(series: list[np.ndarray], order: tuple[int, int, int], horizon: int, z: float = 1.2815515655446004) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, lower, upper, ok) of the next steps of many short series, as kernels.forecast; rows of series that can't be
    fitted are not ok. Fits come from Gram matrices; then all series go through the horizon together."""
    p, d, q = order
    count = len(series)
    ok = np.zeros(count, bool)
    c, variance, last = np.zeros(count), np.zeros(count), np.zeros((count, d))
    phi, theta, past, shocks = np.zeros((count, p)), np.zeros((count, q)), np.zeros((count, p)), np.zeros((count, q))
    middle = np.array([y.mean() if len(y) else 0.0 for y in series])
    for k, y in enumerate(series):
        if len(y) <= d or not np.isfinite(y).all():
            continue
        y = y - middle[k]
        w = np.diff(y, d)
        lags = order_lags([(p, q)], len(w))
        rows = lagged(w, lags, lags)
        try:
            c[k], phi[k], theta[k], s, ssr = Orders(rows.T @ rows, w[:lags], len(w)).fit(p, q)
        except (ValueError, np.linalg.LinAlgError):
            continue
        if q:
            moved, squares = filtered(w, 0, packed(p, s, c[k], phi[k], theta[k], p, q)[None], p)
            ssr, shocks[k] = squares[0, 0, 0], moved[0, 0, 1:]
        variance[k], ok[k] = max(ssr, 0.0) / max(len(w) - s, 1), True
        past[k] = w[::-1][:p]
        last[k] = [np.diff(y, j)[-1] for j in range(d)]
    mean, psi = np.empty((count, horizon)), np.zeros((count, horizon))
    poly = np.concatenate([np.ones((count, 1)), -phi], axis=1)
    for _ in range(d):
        poly = np.concatenate([poly, np.zeros((count, 1))], axis=1) - np.concatenate([np.zeros((count, 1)), poly], axis=1)
    for h in range(horizon):
        v = c + (phi * past).sum(1) + (theta * shocks).sum(1)
        past = np.concatenate([v[:, None], past], axis=1)[:, :p]
        shocks = np.concatenate([np.zeros((count, 1)), shocks], axis=1)[:, :q]
        for j in range(d - 1, -1, -1):
            last[:, j] = v = last[:, j] + v
        mean[:, h] = v
        psi[:, h] = 1.0 if h == 0 else theta[:, h - 1] if h <= q else 0.0
        for j in range(1, min(poly.shape[1], h + 1)):
            psi[:, h] -= poly[:, j] * psi[:, h - j]
    mean += middle[:, None]
    band = z * np.sqrt(variance[:, None] * np.cumsum(psi**2, axis=1))
    return mean, mean - band, mean + band, ok


# --- many short series at once --------------------------------------------------------------------------------------


def lots(sizes: np.ndarray, kinds: list, most: int = 20_000) -> Iterator[np.ndarray]:
    """Places of series of one kind and about one size, in lots of at most `most` padded rows, or one series."""
    by: dict = {}
    for k in np.argsort(sizes, kind="stable"):
        by.setdefault(kinds[k], []).append(k)
    for places in by.values():
        while places:
            count = len(places)
            while count > 1 and count * sizes[places[count - 1]] > most:
                count = max(count // 2, 1)
            yield np.array(places[:count])
            places = places[count:]


def padded(series: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(series), max(map(len, series))))
    for k, y in enumerate(series):
        out[k, : len(y)] = y
    return out


def stacked(v: np.ndarray, n: np.ndarray, lags: int) -> np.ndarray:
    """lagged(v, lags, 0) of every padded series: what lies before a series is 0, rows from n on are 0."""
    back = sliding_window_view(np.pad(v, ((0, 0), (lags, 0))), lags + 1, axis=1)[:, :, ::-1]
    return np.concatenate([np.ones((*v.shape, 1)), back], axis=2) * (np.arange(v.shape[1]) < n[:, None])[:, :, None]


def products(z: np.ndarray) -> np.ndarray:
    return np.swapaxes(z, 1, 2) @ z


def solve_many(g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """solve for each of many matrices, and whether it is finite; others are solved as 0."""
    finite = np.isfinite(g).all((1, 2))
    g = np.where(finite[:, None, None], g, 0.0)
    scale = 1 / np.sqrt(np.maximum(np.einsum("bii->bi", g)[:, :k], 1e-300))
    both = scale[:, :, None] * scale[:, None, :]
    inverse = np.linalg.pinv(g[:, :k, :k] * both, rcond=1e-13, hermitian=True) * both
    beta = np.einsum("bij,bj->bi", inverse, g[:, :k, -1])
    return beta, np.maximum(g[:, -1, -1] - np.einsum("bi,bi->b", beta, g[:, :k, -1]), 0.0), inverse, finite


def adf_many(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(d, tau) of every series as forecast.adf_by_entity: the first of 0, 1, 2 differences whose unit root is rejected, else 2."""
    d, tau = np.full(len(series), 2), np.full(len(series), np.nan)
    left = np.arange(len(series))
    for k in range(3):
        sizes = np.array([len(series[i]) - k for i in left], int)
        rejected = np.zeros(len(left), bool)
        tau[left] = np.nan
        for lot in lots(sizes, [adf_lags(n) for n in sizes]):
            tau[left[lot]], rejected[lot] = _adf_lot([np.diff(series[i], k) for i in left[lot]], sizes[lot])
        d[left[rejected]] = k
        left = left[~rejected]
    return d, tau


def _adf_lot(series: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """adf_verdict of series with equally many lags."""
    most, tau, flat = adf_lags(n[0]), np.full(len(n), np.nan), np.array([np.ptp(v) == 0 for v in series])
    rejected = flat & (n >= 10)
    use = np.flatnonzero(~flat & (n >= 10))
    if not len(use):
        return tau, rejected
    n, v = n[use], padded([series[i] for i in use])
    z = stacked(padded([np.diff(series[i]) for i in use]), n - 1, most)  # 1, d[i], d[i - 1], ...
    level = v[:, :-1, None] * (np.arange(v.shape[1] - 1) < n[:, None] - 1)[:, :, None]
    z = np.concatenate([z[:, :, :1], level, z[:, :, 2:], z[:, :, 1:2]], axis=2)
    g, rows = products(z[:, most:]), n - 1 - most
    aic = []
    for k in range(most + 1):
        keep = [*range(k + 2), most + 2]
        _, ssr, _, finite = solve_many(g[:, keep][:, :, keep], k + 2)
        ssr = np.where(ssr > 1e-14 * g[:, -1, -1], ssr, 0.0)
        aic.append(rows * np.log(np.maximum(ssr, 1e-300) / rows) + 2 * (k + 2))
    best = np.argmin(aic, axis=0)
    for k in np.unique(best):
        at = np.flatnonzero(best == k)
        keep = [*range(k + 2), most + 2]
        x = z[at][:, :, keep]
        beta, ssr, inverse, finite = solve_many(g[at][:, keep][:, :, keep] + products(x[:, k:most]), k + 2)
        t = n[at] - 1 - k
        se = np.sqrt(np.maximum(inverse[:, 1, 1] * ssr / np.maximum(t - k - 2, 1), 0.0))
        found = np.where(finite, np.where(se > 0, beta[:, 1] / np.where(se > 0, se, 1.0), -np.inf), np.nan)
        tau[use[at]] = found
        rejected[use[at]] = found < sum(b / t**i for i, b in enumerate(ADF_5))
    return tau, rejected


def orders_many(series: list[np.ndarray], ds: np.ndarray, orders: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(AIC, failure) of every order (p, q) for every series after its differences ds. failure: 0 none, 1 short, 2 too short."""
    n = np.array([len(y) for y in series], int) - ds
    aic, failed = np.full((len(series), len(orders)), np.nan), np.ones((len(series), len(orders)), int)
    some = np.flatnonzero(n > min(p + q for p, q in orders) + 5)
    for lot in lots(n[some], [tuple(long_lags(p, q, m) for p, q in orders) for m in n[some]]):
        at = some[lot]
        aic[at], failed[at] = _orders_lot([np.diff(series[i], ds[i]) for i in at], n[at], orders)
    return aic, failed


def _orders_lot(series: list[np.ndarray], n: np.ndarray, orders: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """orders_many of series whose long autoregressions have equally many lags. As Orders.fit, and the residuals of all mixed
    orders go through the series together."""
    lags, w = order_lags(orders, n[0]), padded(series)
    z = stacked(w, n, lags)
    whole = products(z[:, lags:])
    grams: dict[int, np.ndarray] = {}

    def gram(start: int) -> np.ndarray:
        if start not in grams:
            grams[start] = whole + products(z[:, start:lags])
        return grams[start]

    count, unit = len(n), np.eye(lags + 2)
    squares, failed = np.zeros((count, len(orders))), np.zeros((count, len(orders)), int)
    firsts, mixed = [], []
    for i, (p, q) in enumerate(orders):
        m = long_lags(p, q, n[0])
        s = max(p, m + q)
        firsts.append(s)
        t = np.zeros((count, lags + 2, p + q + 2))
        t[:, :, 0], t[:, :, 1 : p + 1], t[:, :, -1] = unit[0], unit[:, 2 : 2 + p], unit[1]
        finite = True
        if q:
            keep = [0, *range(2, 2 + m), 1]
            beta, _, _, finite = solve_many(gram(m)[:, keep][:, :, keep], m + 1)
            for j in range(1, q + 1):
                t[:, 0, p + j] = -beta[:, 0]
                t[:, 1 + j, p + j] = 1
                t[:, 2 + j : 2 + j + m, p + j] -= beta[:, 1:]
        beta, squares[:, i], _, good = solve_many(np.swapaxes(t, 1, 2) @ gram(s) @ t, p + q + 1)
        failed[:, i] = np.where(n <= p + q + 5, 1, np.where((n - s < p + q + 2) | ~(good & finite), 2, 0))
        if q:
            theta = beta[:, p + 1 :]
            companion = np.zeros((count, q, q))
            companion[:, 0] = -theta
            companion[:, np.arange(1, q), np.arange(q - 1)] = 1
            largest = np.abs(np.linalg.eigvals(companion)).max(1)
            theta = np.where(largest[:, None] >= 0.999, theta * 0.9 / np.maximum(largest, 0.999)[:, None], theta)
            mixed.append((i, p, q, s, beta[:, 0], beta[:, 1 : p + 1], theta))
    if mixed:
        widest = max(q for _, _, q, *_ in mixed)
        u, thetas = np.empty((w.shape[1], len(mixed), count)), np.zeros((widest, len(mixed), count))
        for k, (_, p, q, _, c, phi, theta) in enumerate(mixed):
            u[:, k] = (w - c[:, None] - np.einsum("btj,bj->bt", z[:, :, 2 : 2 + p], phi)).T
            u[:p, k], thetas[:q, k] = 0.0, theta.T
        begun, counts = np.array([[p] for _, p, *_ in mixed]), np.array([[s] for _, _, _, s, *_ in mixed])
        past, total = [np.zeros((len(mixed), count)) for _ in range(widest)], np.zeros((len(mixed), count))
        for t in range(w.shape[1]):
            e = u[t] - sum(thetas[j] * past[j] for j in range(widest))
            if t < begun.max():
                e = np.where(t >= begun, e, 0.0)
            past = [e, *past[:-1]]
            total += np.where((t >= counts) & (t < n), e * e, 0.0)
        squares[:, [i for i, *_ in mixed]] = total.T
    variance = np.maximum(squares, 0.0) / np.maximum(n[:, None] - np.array(firsts), 1)
    sizes = np.array([p + q + 2 for p, q in orders])
    return n[:, None] * (np.log(2 * np.pi * np.maximum(variance, 1e-12)) + 1) + 2 * sizes, failed
