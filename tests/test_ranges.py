"""Long entities dealt by ranges of steps: the same rows as in one window, in many tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import ranges as R
from panelspark.operators import windows
from panelspark.spec import PanelSpec

SPEC = PanelSpec(sensors=("s1",))


@pytest.fixture(scope="module")
def panel(spark):
    """One entity with most rows, gaps between its steps and a run of steps far from the others; some short ones."""
    rng = np.random.default_rng(11)
    steps = np.unique(np.concatenate([rng.integers(1, 900, 700), rng.integers(10**6, 10**6 + 40, 35)]))
    rows = [(1, int(k), float(rng.normal()), int(2000 - i)) for i, k in enumerate(steps)]
    rows += [(e, k, float(rng.normal()), 50 - k) for e in (2, 3, 4) for k in range(1, 10 * e)]
    return spark.createDataFrame(rows, "entity_id long, step int, s1 double, rul int").cache()


@pytest.mark.parametrize("before", [1, 9, 29, 200])
def test_every_range_has_the_rows_before_it(panel, before):
    got = {}
    for r in R.with_halo(panel, before, SPEC, most=100).collect():
        got.setdefault((r.entity_id, r[R.RANGE]), []).append((r.step, r[R.OWN]))
    steps = {e: sorted(r.step for r in panel.where(F.col("entity_id") == e).collect()) for e in (1, 2, 3, 4)}
    assert len([k for k in got if k[0] == 1]) > R.RANGES // 2 and all((e, 0) in got and len([k for k in got if k[0] == e]) == 1 for e in (2, 3, 4))
    own = sorted((k[0], s) for k, v in got.items() for s, mine in v if mine)
    assert own == sorted((e, s) for e, v in steps.items() for s in v)
    for (e, _), v in got.items():
        first = min(s for s, mine in v if mine)
        at = steps[e].index(first)
        assert sorted(s for s, mine in v if not mine) == (steps[e][max(0, at - before) : at] if e == 1 else [])


def same(a, b, digits=9):
    key = lambda r: tuple(str(x) for x in r[:2])
    a, b = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert len(a) == len(b) and a[0].asDict().keys() == b[0].asDict().keys()
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or np.allclose(np.array(u, float), np.array(v, float), atol=10**-digits), (x, y)


@pytest.mark.parametrize("make", [
    lambda p, most: windows.rolling_features(p, (5, 20), SPEC, most),
    lambda p, most: windows.rolling_median(p, "s1", 10, spec=SPEC, most=most),
    lambda p, most: windows.difference(p, "s1", 2, SPEC, most),
    lambda p, most: windows.acf_table(p, "s1", 20, SPEC, most),
    lambda p, most: windows.window_arrays(p, ["s1"], 30, spec=SPEC, most=most),
    lambda p, most: windows.window_arrays(p, ["s1"], 30, True, SPEC, most),
    lambda p, most: windows.window_arrays(p.drop("rul"), ["s1", "step"], 25, spec=SPEC, most=most),
])
def test_rows_equal_one_window(panel, make):
    same(make(panel, 100), make(panel, 10**9))


def test_a_long_entity_is_many_tasks(spark, panel):
    rows = R.with_halo(panel, 19, SPEC, most=100).where(F.col("entity_id") == 1).repartition(40, "entity_id", R.RANGE)
    assert rows.select(F.spark_partition_id()).distinct().count() > 15


def test_runs_of_many_groups_and_batches(spark):
    import pyarrow as pa

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(200).select((F.col("id") % 9).alias("g"), F.col("id").alias("o"), (F.col("id") * 1.5).alias("v"))
        out = R.map_runs(df, ["g"], "o", lambda c: pa.record_batch([pa.array(c["g"][:1]), pa.array([c["v"].tolist()])], names=["g", "v"]), "g bigint, v array<double>")
        assert {r.g: r.v for r in out.collect()} == {g: [1.5 * k for k in range(200) if k % 9 == g] for g in range(9)}
        assert R.map_runs(df.limit(0), ["g"], "o", lambda c: None, "g bigint").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("most", [100, 10**9])
def test_isotonic_fit_of_ranges_equals_one_pass(spark, most):
    """Rising, falling, flat and noisy series, one with a late drop that pools far back, in ranges and whole."""
    from panelspark.operators.health import isotonic_index, pool_adjacent_violators

    rng = np.random.default_rng(4)
    n = 700
    series = {
        1: np.arange(n) + 5 * rng.normal(size=n), 2: -np.arange(n).astype(float), 3: rng.normal(size=n), 4: np.r_[np.arange(n - 3.0), [-9e3, 1.0, 2.0]],
        5: np.zeros(n), 6: np.sin(np.arange(n) / 40) * 10 + rng.normal(size=n), 7: rng.normal(size=30), 8: np.round(rng.normal(size=n), 1).cumsum(), 9: np.array([2.0]),
    }
    df = spark.createDataFrame([(e, 2 * k, float(v)) for e, y in series.items() for k, v in enumerate(y)], "entity_id long, step int, health_index double")
    got = {}
    for r in isotonic_index(df, spec=SPEC, most=most).collect():
        got.setdefault(r.entity_id, []).append((r.step, r.isotonic))
    assert set(got) == set(series)
    for e, y in series.items():
        assert np.allclose([v for _, v in sorted(got[e])], pool_adjacent_violators(y), atol=1e-9), e


def test_recent_rows_of_long_entities(panel):
    for most in (100, 10**9):
        got = sorted((r.entity_id, r.step) for r in windows.recent_window(panel, spec=SPEC, most=60).collect()) if most else None
        long = sorted((r.entity_id, r.step, r["_k"], r["_n"]) for r in R.tail_rows(panel, 60, SPEC, most).collect())
        steps = {e: sorted(r.step for r in panel.where(F.col("entity_id") == e).collect()) for e in (1, 2, 3, 4)}
        want = sorted((e, s, k + 1, len(v)) for e, v in steps.items() for k, s in enumerate(v[::-1][:60]))
        assert long == want
        assert got == sorted((e, s) for e, v in steps.items() for s in v[-min(max(round(0.3 * len(v)), 20), 60) :])
