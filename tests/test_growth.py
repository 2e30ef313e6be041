"""Work that must not be repeated, and batches that must not show in results."""

import numpy as np
import pytest

from panelspark.operators import forecast, learn, windows
from panelspark.operators import grams as G
from panelspark.spec import PanelSpec

SPEC = PanelSpec(sensors=("s1",))


def counted(spark, df):
    """df, and an accumulator of how often a row of it was computed."""
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(tell, df.schema), seen


def test_window_lengths_share_one_reading_of_the_panel(spark):
    rows = [(e, k, float((e * k * 7) % 11), 45 - k) for e in range(1, 7) for k in range(1, 46)]
    df = spark.createDataFrame(rows, "entity_id long, step int, s1 double, rul int")
    (a, seen_a), (b, seen_b) = (counted(spark, x) for x in (df, df.where("entity_id < 3")))
    out = learn.window_length_sensitivity(a, b, ["s1"], widths=(3, 5, 60), spec=SPEC).collect()
    assert sorted(r.width for r in out) == [3, 5, 60] and all(r.n == 2 for r in out)
    assert (seen_a.value, seen_b.value) == (len(rows), 90)


@pytest.mark.parametrize("width", [1, 4, 12])
@pytest.mark.parametrize("last_only", [False, True])
@pytest.mark.parametrize("most", [None, 9])
def test_windows_do_not_depend_on_batches(spark, width, last_only, most):
    """Entities shorter than a window, of its length, longer than batches; values that are null or NaN stay so."""
    rows = [(e, 2 * k, float(e * 100 + k) if (e + k) % 5 else (None, float("nan"))[k % 2], float(k), 50 - k) for e, n in enumerate((1, 3, 4, 11, 12, 13, 40), 1) for k in range(n)]
    df = spark.createDataFrame(rows, "entity_id long, step int, s1 double, s2 double, rul int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {(r.entity_id, r.step): (r.features, r.label) for r in windows.window_arrays(df, ["s1", "s2"], width, last_only, SPEC, most).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for e in range(1, 8):
        own = [r for r in rows if r[0] == e]
        ends = [len(own)] if last_only or len(own) < width else range(width, len(own) + 1)
        for k in ends:
            part = own[max(k - width, 0) : k]
            flat = [0.0] * (2 * (width - len(part))) + [v for r in part for v in r[2:4]]
            want[e, own[k - 1][1]] = (flat, float((own[0] if len(own) < width and not last_only else own[k - 1])[4]))
    assert got.keys() == want.keys()
    for k, (flat, label) in want.items():
        assert got[k][1] == label
        assert all(x is y is None or (x is not None and y is not None and np.array_equal(x, y, equal_nan=True)) for x, y in zip(got[k][0], flat, strict=True)), k


def test_order_search_of_short_series_is_one_pass(spark):
    """One reading to see how long series are, one for tests, fits and residuals."""
    rng = np.random.default_rng(5)
    rows = [(e, k, float(v)) for e in range(1, 6) for k, v in enumerate(np.cumsum(rng.normal(size=30 + 7 * e)))]
    df, seen = counted(spark, spark.createDataFrame(rows, "entity_id long, step int, s1 double"))
    assert forecast.modal_order(forecast.order_grid(df, "s1", spec=SPEC)).count() == 1
    assert seen.value <= 2 * len(rows)


def test_order_search_reads_panels_with_long_series_four_times(spark, monkeypatch):
    """To see that there are long series, to tell and to write them, and for the short ones; sums read what was written."""
    monkeypatch.setattr(forecast, "BATCHED", 100)
    rng = np.random.default_rng(5)
    rows = [(e, k, float(v)) for e in range(1, 6) for k, v in enumerate(np.cumsum(rng.normal(size=60 if e < 4 else 300)))]
    df, seen = counted(spark, spark.createDataFrame(rows, "entity_id long, step int, s1 double"))
    best = forecast.modal_order(forecast.order_grid(df, "s1", spec=SPEC)).collect()
    assert len(best) == 1 and best[0].n >= 1
    assert seen.value <= 4 * len(rows)


def test_batched_and_ranged_fits_agree(spark, monkeypatch):
    """Short series at once, longer ones by sums, in one panel; the constant and the odd one too."""
    rng = np.random.default_rng(3)
    series = [np.cumsum(rng.normal(size=n)) for n in (60, 75, 130, 300)] + [rng.normal(size=n) for n in (7, 9, 12, 200)] + [np.full(40, 2.0), np.where(np.arange(50) == 9, np.inf, 1.0)]
    df = spark.createDataFrame([(e, k, float(v)) for e, y in enumerate(series) for k, v in enumerate(y)], "entity_id long, step int, s1 double")
    told = []
    for size, most in ((100, 150), (2000, None)):
        monkeypatch.setattr(forecast, "BATCHED", size)
        grid = {tuple(r)[:4]: (r.aic, r.status) for r in forecast.order_grid(df.where("entity_id <> 8"), "s1", spec=SPEC, most=most).collect()}
        told.append((grid, {r.entity_id: (r.n, r.d, r.status, r.tau) for r in forecast.adf_by_entity(df, "s1", SPEC, most).collect()}))
    for grid, adf in told[1:]:
        assert grid.keys() == told[0][0].keys() and len(grid) == 9 * 19
        assert all(v[1] == told[0][0][k][1] and (v[0] is None or abs(v[0] - told[0][0][k][0]) < 0.011) for k, v in grid.items())
        assert all(v[:3] == told[0][1][e][:3] and (v[3] is told[0][1][e][3] is None or np.isclose(v[3], told[0][1][e][3], rtol=1e-5)) for e, v in adf.items())


def test_lots_hold_every_series_once():
    sizes, kinds = np.array([5, 900, 3, 5, 4, 60, 5]), list("aabbaaa")
    got = list(G.lots(sizes, kinds, 20))
    assert sorted(np.concatenate(got)) == list(range(7)) and all(len({kinds[k] for k in lot}) == 1 for lot in got)
    assert all(len(lot) == 1 or len(lot) * sizes[lot].max() <= 20 for lot in got)


def test_medians_by_one_sort():
    from panelspark.streaming.features import _medians

    rng = np.random.default_rng(4)
    for width in (1, 2, 9, 10):
        x = np.where(rng.random((200, width)) < 0.3, np.nan, rng.normal(size=(200, width)))
        x = np.concatenate([x[~np.isnan(x).all(1)], np.full((1, width), 3.0)])
        assert np.allclose(_medians(x), np.nanmedian(x, axis=1))
    assert np.isnan(_medians(np.full((1, 3), np.nan))).all() and _medians(np.zeros((0, 3))).shape == (0,)


def test_stream_state_comes_with_the_rows(spark, tmp_path):
    """No call for the state of each entity: the plan has the operator whose state travels in Arrow batches."""
    from panelspark.streaming.features import stream_panel_features

    schema = "entity_id bigint, step int, s1 double"
    spark.createDataFrame([(e, k, float(e + k)) for e in range(40) for k in range(3)], schema).write.parquet(f"{tmp_path}/in")
    out = stream_panel_features(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "s1", windows=(2,), median=2)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [x["operatorName"] for x in q.lastProgress["stateOperators"]] == ["applyInPandasWithState"]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 120
