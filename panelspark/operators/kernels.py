"""NumPy kernels for one entity's series."""

from __future__ import annotations

import math

import numpy as np


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their standard errors and the residual sum of squares."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    ssr = float(rest @ rest)
    free = max(len(y) - x.shape[1], 1)
    var = np.linalg.pinv(x.T @ x) * ssr / free
    return beta, np.sqrt(np.maximum(np.diag(var), 0)), ssr


#: Coefficients of MacKinnon's response surface for the 5 % point of the Dickey-Fuller test with a constant.
ADF_5 = (-2.86154, -2.8903, -4.234, -40.040)


def adf(y: np.ndarray) -> tuple[float, bool]:
    """Augmented Dickey-Fuller statistic with a constant, its lag chosen by AIC; and whether a unit root is rejected at 5 %."""
    y = np.asarray(y, float)
    n = len(y)
    d = np.diff(y)
    if n < 10 or np.ptp(y) == 0:
        return math.nan, np.ptp(y) == 0 and n >= 10
    most = min(int(12 * (n / 100) ** 0.25), n // 2 - 3)
    best = None
    for k in range(max(most, 0) + 1):
        # all candidate lags are compared on the same rows
        rows = len(d) - most
        x = np.column_stack([np.ones(rows), y[most:-1], *[d[most - j : len(d) - j] for j in range(1, k + 1)]])
        _, _, ssr = ols(x, d[most:])
        aic = rows * math.log(max(ssr, 1e-300) / rows) + 2 * x.shape[1]
        if best is None or aic < best[0]:
            best = (aic, k)
    k = best[1]
    x = np.column_stack([np.ones(len(d) - k), y[k:-1], *[d[k - j : len(d) - j] for j in range(1, k + 1)]])
    beta, se, _ = ols(x, d[k:])
    tau = float(beta[1] / se[1]) if se[1] > 0 else -math.inf
    t = len(d) - k
    return tau, tau < sum(b / t**i for i, b in enumerate(ADF_5))


def arma_fit(y: np.ndarray, p: int, q: int) -> tuple[float, np.ndarray, np.ndarray, float, np.ndarray]:
    """(constant, phi, theta, variance, residuals) by Hannan-Rissanen: a long autoregression gives the shocks, then least squares."""
    y = np.asarray(y, float)
    n = len(y)
    shocks = np.zeros(n)
    m = 0
    if q:
        m = min(max(p + q, int(round(math.log(max(n, 2)) ** 1.5))), n // 3)
        x = np.column_stack([np.ones(n - m), *[y[m - j : n - j] for j in range(1, m + 1)]])
        beta, _, _ = ols(x, y[m:])
        shocks[m:] = y[m:] - x @ beta
    s = max(p, m + q)
    if n - s < p + q + 2:
        raise ValueError("too short")
    x = np.column_stack([np.ones(n - s), *[y[s - j : n - j] for j in range(1, p + 1)], *[shocks[s - j : n - j] for j in range(1, q + 1)]])
    beta, _, _ = ols(x, y[s:])
    c, phi, theta = float(beta[0]), beta[1 : p + 1], beta[p + 1 :]
    if q and np.abs(np.roots(np.append(1.0, theta))).max(initial=0) >= 0.999:
        theta = theta * 0.9 / np.abs(np.roots(np.append(1.0, theta))).max()
    e = np.zeros(n)
    for t in range(p, n):
        e[t] = y[t] - c - sum(phi[j] * y[t - 1 - j] for j in range(p)) - sum(theta[j] * e[t - 1 - j] for j in range(min(q, t)))
    rest = e[s:]
    return c, phi, theta, float(rest @ rest / max(len(rest), 1)), e


def aic(y: np.ndarray, p: int, d: int, q: int) -> float:
    w = np.diff(np.asarray(y, float), d)
    _, _, _, variance, _ = arma_fit(w, p, q)
    n = len(w)
    return n * (math.log(2 * math.pi * max(variance, 1e-12)) + 1) + 2 * (p + q + 2)


def psi_weights(phi: np.ndarray, theta: np.ndarray, d: int, h: int) -> np.ndarray:
    """Weights of past shocks in forecast errors of an ARIMA process."""
    poly = np.append(1.0, -np.asarray(phi, float))
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    ar, out = -poly[1:], np.zeros(h)
    for k in range(h):
        v = 1.0 if k == 0 else (theta[k - 1] if k <= len(theta) else 0.0)
        out[k] = v + sum(ar[j] * out[k - 1 - j] for j in range(min(len(ar), k)))
    return out


def forecast(y: np.ndarray, order: tuple[int, int, int], horizon: int, z: float = 1.2815515655446004) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, lower, upper) of the next steps; z: the normal quantile of the band, by default of 80 %."""
    p, d, q = order
    y = np.asarray(y, float)
    levels = [y]
    for _ in range(d):
        levels.append(np.diff(levels[-1]))
    w = levels[-1]
    c, phi, theta, variance, e = arma_fit(w, p, q)
    past, shocks = list(w), list(e)
    for _ in range(horizon):
        v = c + sum(phi[j] * past[-1 - j] for j in range(p)) + sum(theta[j] * shocks[-1 - j] for j in range(q))
        past.append(v)
        shocks.append(0.0)
    mean = np.array(past[len(w) :])
    for k in range(d - 1, -1, -1):
        mean = levels[k][-1] + np.cumsum(mean)
    sd = np.sqrt(variance * np.cumsum(psi_weights(phi, theta, d, horizon) ** 2))
    return mean, mean - z * sd, mean + z * sd


def chi2_tail(x: float, df: float) -> float:
    """P(X > x) of the chi-squared distribution, by the series or continued fraction of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if not x > 0:
        return 1.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - lead * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return lead * h
