import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import scalars as S
from panelspark.operators import crossing, forecast, health, intervals, label, learn, metrics, quality, regimes, windows
from panelspark.operators import kernels as K
from panelspark.plans import fleet
from panelspark.sources import tables, text
from panelspark.spec import PanelSpec

ONE = PanelSpec(sensors=("s1",), cap=125)


@pytest.fixture(scope="module")
def ramp(spark):
    return spark.createDataFrame([(e, k, float(k), "A" if k % 2 else "B") for e in (1, 2) for k in range(1, 41 + e)], "entity_id long, step int, s1 double, regime string")


def test_text_sources(spark, tmp_path):
    rows = [" ".join(map(str, [e, c, *[0.5 * k for k in range(24)]])) for e in (3, 7) for c in (1, 2)]
    (tmp_path / "p.txt").write_text("  \n".join(rows) + "\n\nbroken line\n1 x" + " 1" * 24 + "\n")
    (tmp_path / "t.txt").write_text("11\r\n22\r\n")
    panel, bad = text.read_panel_text(spark, str(tmp_path / "p.txt"))
    assert panel.count() == 4 and bad.count() == 2
    truth = text.read_truth_text(spark, str(tmp_path / "t.txt"))
    assert {(r.engine_id, r.rul_last) for r in text.attach_truth(panel, truth).collect()} == {(3, 11), (7, 22)}
    with pytest.raises(ValueError):
        text.attach_truth(panel, truth.limit(1))


def test_labels_and_leakage_guard(ramp):
    out = label.label_rul_train(ramp, ONE)
    assert label.label_violations(out, ONE).isEmpty()
    with pytest.raises(ValueError):
        label.label_rul_test(ramp, ONE)
    assert "rul_last" not in label.label_rul_test(ramp.withColumn("rul_last", F.lit(3)), ONE).columns


def test_clip_keeps_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (-1.0,), (None,), (9.0,)], "x double").select(S.clip(F.col("x"), 0.0, 5.0).alias("x"))
    got = [r.x for r in df.collect()]
    assert np.isnan(got[0]) and got[1:] == [0.0, None, 5.0]


def test_names(spark):
    row = spark.range(1).select(S.file_name(F.lit("ARIMA(1, 2,2)")).alias("a"), S.base_model(F.lit("GRU+cal80")).alias("b"), S.model_label("AR", F.lit(2)).alias("c"), S.format_time(S.parse_time(F.lit("2024-02-03 04:05:06"))).alias("d")).first()
    assert row == ("ARIMA1__2_2", "GRU", "AR(2)", "2024-02-03 04:05:06")


def test_single_row_regime_takes_all_rows(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("B", 10.0)], "regime string, s1 double")
    p = {r.regime: r for r in regimes.regime_parameters(df, ["s1"]).collect()}
    assert p["A"].s1_mean == 2 and p["A"].s1_std == 1 and abs(p["B"].s1_mean - 14 / 3) < 1e-9
    with pytest.raises(KeyError):
        regimes.apply_regime_scaler(df.withColumn("regime", F.lit("Z")), regimes.regime_parameters(df, ["s1"]), ["s1"])


def test_window_padding(spark, ramp):
    short = label.label_rul_train(ramp.where("step <= 5"), ONE)
    r = windows.window_arrays(short, ["s1"], 8, spec=ONE).where("entity_id = 1").first()
    assert r.features == [0.0] * 3 + [1.0, 2.0, 3.0, 4.0, 5.0] and r.label == 4.0
    assert windows.window_arrays(short, ["s1"], 8, True, ONE).first().label == 0.0
    assert windows.window_arrays(label.label_rul_train(ramp, ONE), ["s1"], 8, spec=ONE).where("entity_id = 1").count() == 41 - 8 + 1


def test_undifference_twice(spark, ramp):
    d2 = windows.difference(ramp, "s1", 2, ONE)
    seeds = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 1.0)], "entity_id long, level double, slope double")
    out = windows.undifference(d2, seeds, 2, ONE).collect()
    assert all(abs(r.value - r.s1) < 1e-9 for r in out)


def test_noiseless_ramp_crosses_when_expected(ramp):
    df = label.label_rul_train(ramp, ONE)
    t = df.limit(1).select(F.lit(60.0).alias("threshold"))
    obs = crossing.with_parameters(crossing.observed(df, "s1", ONE), t, None, 125)
    lin = {r.entity_id: r.rul_linear for r in crossing.linear_extrapolation(obs, ONE).collect()}
    assert abs(lin[1] - 19) < 1e-6 and abs(lin[2] - 18) < 1e-6
    path = crossing.linear_path(obs, spec=ONE)
    got = {r.entity_id: r.rul_pred for r in crossing.rul_from_forecast(path, obs, spec=ONE).collect()}
    assert got == {1: 18.0, 2: 17.0}
    empty = {r.entity_id: r.rul_pred for r in crossing.rul_from_forecast(path.where("false"), obs, spec=ONE).collect()}
    assert abs(empty[1] - 19) < 1e-6
    assert crossing.bounds_from_bands(path, obs, ONE).where("lower_bound > rul_pred or upper_bound < rul_pred").isEmpty()


def test_kernels():
    rng = np.random.default_rng(1)
    e = rng.normal(size=3000)
    ar = np.zeros(3000)
    for t in range(1, 3000):
        ar[t] = 0.7 * ar[t - 1] + e[t]
    _, phi, _, var, _ = K.arma_fit(ar, 1, 0)
    assert abs(phi[0] - 0.7) < 0.05 and abs(var - 1) < 0.1
    ma = e[1:] + 0.5 * e[:-1]
    assert abs(K.arma_fit(ma, 0, 1)[2][0] - 0.5) < 0.1
    assert K.adf(ar)[1] and not K.adf(np.cumsum(e[:400]))[1]
    mean, lo, hi = K.forecast(np.arange(50.0) + 0.01 * rng.normal(size=50), (1, 1, 0), 20)
    assert abs(mean[-1] - 69) < 0.5 and (np.diff(hi - lo) >= 0).all()
    assert abs(K.chi2_tail(3.841458820694124, 1) - 0.05) < 1e-9 and abs(K.chi2_tail(18.307, 10) - 0.05) < 1e-4
    assert np.allclose(windows.durbin_levinson(np.array([1, 0.5, 0.25, 0.125])), [0.5, 0, 0])
    assert health.pool_adjacent_violators(np.array([3.0, 1, 2, 5, 4])).tolist() == [2, 2, 2, 4.5, 4.5]


def test_planted_trend_is_found(spark):
    rng = np.random.default_rng(2)
    rows = []
    for e in range(20):
        n = 60 + e
        for k in range(1, n + 1):
            r = "ABC"[k % 3]
            base = {"A": 0.0, "B": 5.0, "C": -3.0}[r]
            rows.append((e, k, r, *[float(base + (0.05 * k + rng.normal() * 0.3) * (1 if j < 4 else 0) + (rng.normal() if j >= 4 else 0)) for j in range(6)]))
    spec = PanelSpec(sensors=tuple(f"s{j}" for j in range(1, 7)))
    df = label.label_rul_train(spark.createDataFrame(rows, "entity_id long, step int, regime string, " + ", ".join(f"{s} double" for s in spec.sensors)), spec)
    fitted = health.fit_health_index(df, spec)
    assert sorted(r.column for r in fitted["weights"].collect()) == ["s1", "s2", "s3", "s4"]
    out = health.apply_health_index(df, fitted, spec)
    rise = out.groupBy("entity_id").agg(F.regr_slope("health_index", F.col("step").cast("double")).alias("b")).agg(F.min("b")).first()[0]
    assert rise > 0
    with pytest.raises(ValueError):
        health.fit_health_index(df, spec, threshold=0.999)


def test_results_tables(spark, tmp_path):
    df = spark.createDataFrame([(k, "M(1, 2)", float(k), k + 1.0, k - 2.0, k + 3.0) for k in range(10)], "entity_id long, model_name string, true_rul double, rul_pred double, lower_bound double, upper_bound double")
    tables.append_results(df, f"{tmp_path}/log", "classical", "2024-01-01 00:00:00")
    bare = df.withColumns({"lower_bound": F.lit(None).cast("double"), "upper_bound": F.lit(None).cast("double"), "rul_pred": F.col("true_rul")})
    tables.append_results(bare, f"{tmp_path}/log", "classical", "2024-01-02 00:00:00")
    log = spark.read.parquet(f"{tmp_path}/log")
    a = tables.latest_results(log).first()
    b = tables.latest_results(log, by_column=False).first()
    assert a.rmse == b.rmse == 0.0 and a.interval_width == 5.0 and b.interval_width is None and a.coverage_pct == 100.0
    tables.write_predictions(df, f"{tmp_path}/p")
    assert tables.load_predictions(spark, f"{tmp_path}/p", "M(1, 2)").count() == 10
    with pytest.raises(FileNotFoundError):
        tables.load_predictions(spark, f"{tmp_path}/p", "none")
    with pytest.raises(ValueError):
        tables.write_predictions(df.withColumn("lower_bound", F.lit(99.0)), f"{tmp_path}/q")
    tables.save_parameters({"x": log}, f"{tmp_path}/par")
    assert tables.load_parameters(spark, f"{tmp_path}/par", ["x"])["x"].count() == 2


def test_conformal_margin_equals_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [("m", float(t), float(t - a), float(t + b)) for t, a, b in rng.normal(size=(37, 3)) * [30, 3, 3] + [60, 1, 1]]
    df = spark.createDataFrame(rows, "model_name string, true_rul double, lower_bound double, upper_bound double")
    s = np.sort([max(lo - t, t - hi, 0) for _, t, lo, hi in rows])
    got = {r.target: r.delta for r in intervals.conformal_margin(df, (0.8, 0.9)).collect()}
    for target, delta in got.items():
        assert abs(delta - np.quantile(s, min(np.ceil(38 * target) / 37, 1))) < 1e-9
    rep = intervals.calibration_report(df.withColumn("rul_pred", F.col("true_rul")), df, cap=10**6)
    assert all(r.after >= r.before for r in rep.collect())


def test_buckets_and_bad_values(spark):
    df = spark.createDataFrame([("m", 125.0, float("nan"), 130.0, 120.0), ("m", 10.0, -5.0, 0.0, 20.0)], "model_name string, true_rul double, rul_pred double, lower_bound double, upper_bound double")
    assert intervals.coverage_by_bucket(df).count() == 2 and intervals.coverage_by_bucket(df, close_last=False).count() == 1
    v = intervals.validate_predictions(df).first()
    assert (v.negative, v.inverted, v.outside, v.not_finite) == (1, 0, 1, 1)


def test_learned(spark):
    rng = np.random.default_rng(4)
    rows = [(e, k, float(k + rng.normal()), float(rng.normal()), "A") for e in range(16) for k in range(1, 50 + e % 5)]
    spec = PanelSpec(sensors=("s1", "s2"))
    df = label.label_rul_train(spark.createDataFrame(rows, "entity_id long, step int, s1 double, s2 double, regime string"), spec)
    a = windows.window_arrays(df.where("entity_id < 12"), ["s1", "s2"], 5, spec=spec)
    b = windows.window_arrays(df.where("entity_id >= 12"), ["s1", "s2"], 5, spec=spec)
    model = learn.fit_point_regressor("linear", a)
    assert metrics.evaluate(learn.score_windows(model, b, "linear")).first().rmse < 5
    boosted, history = learn.fit_boosted(a, b, "asymmetric", rounds=3)
    h = [r.valid for r in history.orderBy("round").collect()]
    assert h[-1] < h[0] and learn.score_boosted(boosted, b).where("rul_pred < 0 or rul_pred > 125").isEmpty()
    q = learn.score_quantiles(learn.fit_quantile_regressor(a), b)
    assert q.where("q10 > q50 or q50 > q90 or q10 < 0 or q90 > 125").isEmpty()
    with pytest.raises(KeyError):
        learn.fit_point_regressor("none", a)
    own = learn.predict_with(df, lambda y, t: {"rul": t - y[-1], "lower": 0.0, "upper": 9.0}, 60.0, "s1", spec)
    assert own.count() == 16 and own.where("upper_bound <> 9").isEmpty()


def test_scale_sensors_plan(spark):
    rng = np.random.default_rng(5)
    rows = [(e, k, float(k % 2) * 10, 0.0, float(rng.normal() + 5 * (k % 2)), 7.0) for e in range(6) for k in range(1, 30)]
    spec = PanelSpec(sensors=("s1", "s2"), regime="op_cluster")
    df = spark.createDataFrame(rows, "entity_id long, step int, op1 double, op2 double, s1 double, s2 double")
    a, b, state, kept = fleet.scale_sensors(df.where("entity_id < 4"), df.where("entity_id >= 4"), k=6, spec=spec)
    assert kept == ["s1"] and len(state["centres"]) == 2 and "s2" not in b.columns
    assert quality.scaling_violations(a, spec=PanelSpec(sensors=("s1",), regime="op_cluster")).isEmpty()


def test_grouped_maps_report_short_series(spark):
    df = spark.createDataFrame([(1, k, float(k)) for k in range(5)] + [(2, k, float(k % 3)) for k in range(40)], "entity_id long, step int, s1 double")
    assert {r.entity_id: r.status for r in forecast.adf_by_entity(df, "s1", ONE).collect()} == {1: "short", 2: "ok"}
    assert forecast.forecast_by_entity(df, "s1", (1, 0, 0), 7, smooth=1, spec=ONE).where("entity_id = 1").isEmpty()
    w = forecast.walk_forward(df, "s1", (2, 0, 0), spec=ONE)
    assert w.count() == 12 and {r.step for r in w.collect()} == set(range(28, 40))


def test_order_grid_reaches_the_reference(spark):
    rng = np.random.default_rng(6)
    n = 400
    e = rng.normal(size=n)
    ar, walk, ma = np.zeros(n), np.cumsum(rng.normal(size=n)), np.zeros(n)
    for k in range(3, n):
        ar[k] = 0.1 * ar[k - 1] - 0.2 * ar[k - 2] + 0.6 * ar[k - 3] + e[k]
        ma[k] = 0.5 * ma[k - 1] + e[k] + 0.3 * e[k - 1] + 0.8 * e[k - 2]
    twice = np.cumsum(np.cumsum(rng.normal(size=n)))
    rows = [(i, k, float(v)) for i, y in enumerate((ar, walk, ma, twice), 1) for k, v in enumerate(y)] + [(5, k, float(k)) for k in range(4)]
    df = spark.createDataFrame(rows, "entity_id long, step int, s1 double")
    grid = forecast.order_grid(df, "s1", spec=ONE).persist()
    assert {(r.p, r.q) for r in grid.where("entity_id = 1").collect()} == {*((p, 0) for p in range(1, 11)), *((p, q) for p in (1, 2, 3) for q in (1, 2, 3))}
    assert grid.count() == 5 * 19 and {r.status for r in grid.where("entity_id = 5").collect()} == {"short"}
    best = {r.entity_id: (r.p, r.d, r.q) for r in forecast.best_orders(grid).collect()}
    assert {i: o[1] for i, o in best.items()} == {1: 0, 2: 1, 3: 0, 4: 2}
    assert best[1][0] >= 3 and (best[3][2] >= 2 or best[3][0] >= 3)
    assert {(r.p, r.d, r.q) for r in forecast.order_grid(df, "s1", (1, 2), (1,), (0, 1), ONE).collect()} == {(p, 1, q) for p in (1, 2) for q in (0, 1)}


def test_boosting_stops_by_patience(spark):
    rng = np.random.default_rng(7)
    rows = [([float(rng.normal())], float(rng.integers(0, 40))) for _ in range(60)]
    a, b = (spark.createDataFrame(x, "features array<double>, label double") for x in (rows[:40], rows[40:]))
    model, history = learn.fit_boosted(a, b, "squared")
    h = [r.valid for r in history.orderBy("round").collect()]
    assert 10 < len(h) < 50 and len(h) - (h.index(min(h)) + 1) == 10 and len(model["trees"]) == len(h) - 10


def test_fleet_by_forecast_with_fallback(spark):
    """Noiseless ramps cross where their lines do; an entity too short for the order gets the fallback row."""
    rows = [(e, k, 0.01 * e * k) for e, n in ((1, 60), (2, 40), (3, 4)) for k in range(1, n + 1)]
    df = spark.createDataFrame(rows, "entity_id int, step int, hi double")
    t = spark.createDataFrame([(1.0,)], "threshold double")
    out = {r.entity_id: r for r in crossing.predict_fleet(df, t, None, 0.5, "hi", ONE, crossing.forecast_predictor(smooth=1, index="hi", spec=ONE)).collect()}
    assert set(out) == {1, 2, 3}
    for e, n in ((1, 60), (2, 40)):
        assert abs(out[e].rul_pred * 2 - (100 / e - n)) <= 2 and out[e].lower_bound <= out[e].rul_pred <= out[e].upper_bound
    assert (out[3].lower_bound, out[3].upper_bound) == (0.0, 125.0)


def test_best_of_a_grid(spark):
    grid = spark.createDataFrame([(0.1, 5.0), (0.2, 3.0), (0.3, 3.0)], "q double, rmse double")
    assert metrics.best_of_grid(grid, "rmse", "q").first().q == 0.2


def test_estimator_and_model(spark, tmp_path):
    rows = [(k, [float(k), 1.0], float(100 - k)) for k in range(60)]
    df = spark.createDataFrame(rows, "entity_id int, features array<double>, label double")
    name = next(n for n, f in learn.REGISTRY.items() if "LinearRegression" in type(f()).__name__)
    model = learn.RulEstimator(name).fit(df)
    model.save(f"{tmp_path}/m")
    for m in (model, learn.RulModel.load(spark, f"{tmp_path}/m")):
        out = m.transform(df)
        assert out.columns == [*df.columns, "rul_pred"] and all(abs(r.rul_pred - r.label) < 1 for r in out.collect())
    with pytest.raises(KeyError):
        learn.RulEstimator("none").fit(df)


def test_regimes_are_broadcast(spark):
    df = spark.createDataFrame([(k, k % 3, float(k)) for k in range(30)], "step int, regime int, s1 double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = regimes.apply_regime_scaler(df, regimes.regime_parameters(df, ["s1"]), ["s1"])
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
