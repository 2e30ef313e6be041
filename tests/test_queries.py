"""Every registered panel query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from panelspark import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = ["events", "lineitem"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = [[plain(r[c]) for c in names] for r in df.collect()]
    rel = duck.sql(Q.ORACLE_SQL[name])
    assert sorted(rel.columns) == names
    want = [[plain(r[rel.columns.index(c)]) for c in names] for r in rel.fetchall()]
    key = lambda r: [(v is None, f"{float(v):.3f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in r]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (x is not None and y is not None and abs(float(x) - float(y)) <= 2e-6 * max(1.0, abs(float(y)))), (a, b)


def rising(rows):
    """Within an entity the fit never falls, and its sum is that of the index."""
    by = {}
    for r in sorted(rows, key=lambda r: (r.entity_id, r.step)):
        by.setdefault(r.entity_id, []).append(r)
    return len(by) == 10 and all(all(a.isotonic <= b.isotonic + 1e-9 for a, b in zip(v, v[1:])) and abs(sum(r.isotonic - r.hi for r in v)) < 1e-6 for v in by.values())


def shares(rows):
    rows = sorted(rows)
    return abs(sum(r.share for r in rows) - 1) < 1e-9 and all(a.share >= b.share for a, b in zip(rows, rows[1:])) and abs(rows[-1].cumulative - 1) < 1e-9


#: What must hold of the rows of queries that no SQL expresses.
LEARNED = {
    "d_distribution": lambda rows: {r.d for r in rows} <= {0, 1, 2} and sum(r.n for r in rows) == 15,
    "fit_health_index": lambda rows: len({r.entity_id for r in rows}) == 2 and all(r.health_index is not None and math.isfinite(r.health_index) for r in rows),
    "pca_diagnostics": shares,
    "threshold_sensitivity": lambda rows: len(rows) == 15 and all(a.sensors >= b.sensors for a, b in zip(sorted(rows), sorted(rows)[1:])) and all(r.share is None or 0 < r.share <= 1 + 1e-9 for r in rows),
    "isotonic_index": rising,
    "adf_by_entity": lambda rows: len(rows) == 15 and all(r.status == "ok" and r.d in (0, 1, 2) for r in rows),
    "order_grid": lambda rows: len(rows) == 15 * 19 and all((r.aic is None) == (r.status != "ok") for r in rows) and {(r.p, r.q) for r in rows} == {*((p, 0) for p in range(1, 11)), *((p, q) for p in (1, 2, 3) for q in (1, 2, 3))},
    "modal_order": lambda rows: len(rows) == 1 and 1 <= rows[0].n <= 15 and 1 <= rows[0].p <= 10,
    "forecast_by_entity": lambda rows: len(rows) == 15 * 150 and all(r.lo <= r.mean <= r.hi for r in rows),
    "walk_forward": lambda rows: {r.status for r in rows} <= {"ok", "persistence"} and sum((r.actual - r.predicted) ** 2 for r in rows) < 2 * sum(r.actual**2 for r in rows),
    "predict_fleet_by_forecast": lambda rows: len(rows) == 10 and all(0 <= r.lower_bound <= r.rul_pred + 1e-9 <= r.upper_bound + 2e-9 <= 125 + 3e-9 for r in rows),
    "fit_point_regressor": lambda rows: len(rows) == 3 and all(0 <= r.rul_pred <= 40 for r in rows),
    "fit_quantile_regressor": lambda rows: len(rows) == 3 and all(0 <= r.q10 <= r.q50 <= r.q90 <= 40 for r in rows),
    "input_importance": lambda rows: len(rows) == 90 and abs(sum(r.importance for r in rows) - 1) < 1e-6,
}


@pytest.mark.parametrize("name", sorted(LEARNED))
def test_properties_hold(spark, name):
    assert LEARNED[name](Q.QUERIES[name](spark, SF).collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_regime_queries_try_all_of_the_reference(spark):
    rows = Q.QUERIES["choose_k"](spark, SF).collect()
    assert [r.k for r in sorted(rows)] == list(range(1, 11))
    assert sum(bool(r.best_silhouette) for r in rows) == sum(bool(r.elbow) for r in rows) == 1
    assert Q.QUERIES["fit_regimes"](spark, SF).count() == 6


def test_forecast_queries_run_all_of_the_reference(spark):
    assert Q.QUERIES["forecast_by_entity"](spark, SF).agg({"at": "max"}).first()[0] == 149
    assert {r.width for r in Q.QUERIES["window_length_sensitivity"](spark, SF).collect()} == {10, 20, 30, 50, 75}
