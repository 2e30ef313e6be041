"""Fits from sums of lag products over ranges against plain fits of whole series."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import forecast
from panelspark.operators import grams as G
from panelspark.operators import kernels as K
from panelspark.spec import PanelSpec

SPEC = PanelSpec(sensors=("s1",))


def ar(n, phi, rng, level=0.0):
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = phi * y[t - 1] + rng.normal()
    return y + level


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(8)
    out = {1: ar(900, 0.6, rng, 100.0), 2: np.cumsum(rng.normal(size=80)) + 1e4, 3: np.cumsum(np.cumsum(rng.normal(size=70))), 4: ar(12, 0.3, rng), 5: rng.normal(size=7), 6: np.full(40, 3.0), 8: ar(45, -0.5, rng), 9: ar(25, 0.2, rng)}
    out[7] = np.where(np.arange(60) == 40, np.nan, ar(60, 0.5, rng))
    return out


@pytest.fixture(scope="module")
def panel(spark, series):
    rows = [(e, 3 * k + 1, float(v)) for e, y in series.items() for k, v in enumerate(y)]
    return spark.createDataFrame(rows, "entity_id long, step int, s1 double").repartition(5).cache()


@pytest.mark.parametrize("most", [100, 10**9])
def test_unit_roots_equal_the_plain_test(panel, series, most):
    """Entity 1 in ranges of a few rows, and whole."""
    got = {r.entity_id: r for r in forecast.adf_by_entity(panel, "s1", SPEC, most).collect()}
    assert set(got) == set(series)
    for e, y in series.items():
        r = got[e]
        if e in (5, 7):
            assert (r.n, r.d, r.tau, r.status) == (len(y), None, None, "short" if e == 5 else "not finite")
            continue
        tau, d = None, 2
        for k in range(3):
            tau, reject = K.adf(np.diff(y, k))
            if reject:
                d = k
                break
        assert (r.n, r.d, r.status) == (len(y), d, "ok") and (math.isnan(tau) and r.tau is None or np.isclose(r.tau, tau, rtol=1e-5))


@pytest.mark.parametrize("most, ps, ds, qs", [(100, None, None, None), (10**9, None, None, None), (100, (1, 4), (0, 1, 2), (0, 2)), (100, (2, 3), (1,), (0,))])
def test_orders_equal_plain_fits(panel, series, most, ps, ds, qs):
    some = panel.where(F.col("entity_id") != 6)  # of a constant series all orders fit alike
    got = {(r.entity_id, r.p, r.d, r.q): r for r in forecast.order_grid(some, "s1", ps, ds, qs, SPEC, most).collect()}
    own = {r.entity_id: 1 if r.d is None else r.d for r in forecast.adf_by_entity(panel, "s1", SPEC).collect()}
    pairs = [*forecast.AR_ORDERS, *forecast.ARMA_ORDERS] if ps is None else list(itertools.product(ps, qs))
    want = {(e, p, d, q) for e in series if e != 6 for p, q in pairs for d in (ds or [own[e]])}
    assert set(got) == want
    for (e, p, d, q), r in got.items():
        y = series[e]
        if e == 7:
            assert r.status == "not finite" and r.aic is None
        elif len(y) <= p + d + q + 5:
            assert r.status == "short" and r.aic is None
        else:
            try:
                want = K.aic(y, p, d, q)
            except ValueError as x:
                assert r.status == str(x)
            else:
                assert r.status == "ok" and abs(r.aic - want) < 0.011, (e, p, d, q, r, want)


@pytest.mark.parametrize("order, window, most", [((1, 0, 0), 1, 100), ((1, 0, 0), 5, 100), ((3, 1, 0), 5, 100), ((2, 2, 0), 3, 100), ((0, 1, 0), 2, 100), ((2, 1, 0), 1, 10**9), ((2, 0, 0), 40, 100), ((1, 0, 1), 4, 10**9)])
def test_walking_forward_equals_refits(panel, series, order, window, most):
    some = panel if order[2] == 0 else panel.where(F.col("entity_id") != 1)
    got = {(r.entity_id, r.step): r for r in forecast.walk_forward(some, "s1", order, window=window, spec=SPEC, most=most).collect()}
    want = {}
    for e, y in series.items():
        if len(y) < 20 or (e == 1 and order[2]):
            continue
        if e == 7 and order[0] == 0:  # of values that aren't finite a mean alone is no fit either
            y = y[:40]
            got = {k: r for k, r in got.items() if k[0] != 7}
            continue
        begin = int(np.floor(len(y) * 0.7))
        for origin in range(begin, len(y), window):
            try:
                values, status = K.forecast(y[:origin], order, window)[0], "ok"
            except (ValueError, np.linalg.LinAlgError):
                values, status = np.repeat(y[origin - 1], window), "persistence"
            for k in range(origin, min(origin + window, len(y))):
                want[e, 3 * k + 1] = (y[k], values[k - origin], status)
    assert set(got) == set(want)
    for k, (actual, value, status) in want.items():
        r = got[k]
        assert np.isclose(r.actual, actual, rtol=1e-9, equal_nan=True) and r.status == status, k
        assert np.isclose(r.predicted, value, rtol=1e-6, atol=1e-6, equal_nan=True), (k, r, value)


def test_residual_squares_do_not_depend_on_the_cuts():
    rng = np.random.default_rng(1)
    w = ar(500, 0.4, rng)
    fits = np.array([G.packed(p, s, 0.1, np.full(p, 0.2), np.linspace(0.5, -0.3, q), 3, 3) for p, q, s in ((1, 1, 9), (3, 3, 14), (2, 2, 20))])
    want = []
    for p, s, c, *rest in fits:
        e = np.zeros(len(w))
        for t in range(int(p), len(w)):
            e[t] = w[t] - c - sum(rest[j] * w[t - 1 - j] for j in range(3) if t - 1 - j >= 0) - sum(rest[3 + j] * e[t - 1 - j] for j in range(3) if t - 1 - j >= 0)
        want.append((e[int(s) :] ** 2).sum())
    for cuts in ([0, 500], [0, 40, 41, 300, 500]):
        chain = None
        for a, b in itertools.pairwise(cuts):
            part = G.filtered(w[:b], a, fits, 3)
            chain = part if chain is None else G.chained(chain, part)
        assert np.allclose(chain[1][:, 0, 0], want)


def test_rows_shuffled_stay_in_proportion(spark):
    """One long series: walking forward copies a few rows for each range, not a history for each block of origins."""
    from panelspark.operators.ranges import RANGES, with_halo

    n = 20000
    df = spark.range(n).select(F.lit(1).cast("bigint").alias("entity_id"), (F.col("id") + 1).cast("int").alias("step"), F.sin("id").alias("s1"))
    assert n < with_halo(df, 5, SPEC, most=1000).count() <= n + 5 * RANGES
    assert forecast.walk_forward(df, "s1", (2, 0, 0), window=5, spec=SPEC, most=1000).count() == n - int(n * 0.7)


@pytest.mark.parametrize("order", [(1, 1, 0), (2, 0, 0), (0, 1, 0), (3, 2, 0), (1, 1, 2), (2, 0, 1)])
def test_forecasts_in_batches_equal_single_ones(spark, panel, series, order):
    got = {r.entity_id: r for r in forecast.forecast_paths(panel, "s1", order, 30, smooth=1, recent=False, spec=SPEC).collect()}
    p, d, q = order
    for e, y in series.items():
        try:
            if not np.isfinite(y).all() or len(y) <= p + d + q + (5 if q == 0 else 3):
                raise ValueError
            want = K.forecast(y, order, 30)
        except ValueError:
            assert e not in got
            continue
        if e == 6 and p + q:
            continue  # of a constant series other coefficients fit alike
        assert np.allclose([got[e].mean, got[e].lo, got[e].hi], want, rtol=1e-5, atol=1e-5), (e, order)
    rows = forecast.forecast_by_entity(panel, "s1", order, 30, smooth=1, recent=False, spec=SPEC)
    assert rows.count() == 30 * len(got) and rows.columns == ["entity_id", "at", "mean", "lo", "hi"]
