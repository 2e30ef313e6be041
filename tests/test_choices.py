"""Alternative rules, distributions and saved state."""

import numpy as np
from pyspark.sql import functions as F

from panelspark.operators import crossing, forecast, regimes
from panelspark.sources import tables
from panelspark.spec import PanelSpec

ONE = PanelSpec(sensors=("s1",), cap=125)


def test_short_tail_as_a_share(spark):
    y = [0.02 * max(0, k - 85) for k in range(1, 101)]
    df = spark.createDataFrame([(1, k, y[k - 1]) for k in range(1, 101)], "entity_id long, step int, hi double")
    plain = crossing.observed(df, "hi", ONE).first()
    share = crossing.observed(df, "hi", ONE, short_share=True).first()
    assert abs(plain.slope_short - 0.02) < 1e-12
    assert abs(share.slope_short - np.polyfit(np.arange(20), y[-20:], 1)[0]) < 1e-12
    assert plain.slope_long == share.slope_long


def test_flat_past_the_threshold(spark):
    obs = spark.createDataFrame([(1, 50, 2.0, 0.0, 0.0, 1.0, 33.0)], "entity_id long, n long, last double, slope_long double, slope_short double, threshold double, fallback double")
    path = spark.createDataFrame([(1, k, 2.0) for k in range(40)], "entity_id long, at int, mean double")
    assert crossing.rul_from_forecast(path, obs, spec=ONE).first().rul_pred == 33.0
    assert crossing.rul_from_forecast(path, obs, spec=ONE, plain=True).first().rul_pred == 125.0


def test_d_distribution_counts_tested_entities(spark):
    adf = spark.createDataFrame([(1, 0, "ok"), (2, 1, "ok"), (3, 1, "ok"), (4, None, "short")], "entity_id long, d int, status string")
    assert {(r.d, r.n) for r in forecast.d_distribution(adf).collect()} == {(0, 1), (1, 2)}
    assert forecast.d_distribution(adf.limit(0)).isEmpty()


def test_stage_tables_keep_entities_together(spark, tmp_path):
    panel = spark.createDataFrame([(e, k, float(k)) for k in range(30, 0, -1) for e in range(8)], "entity_id long, step int, s1 double").repartition(5)
    tables.write_stage(panel, str(tmp_path / "stage"), ONE)
    back = tables.read_stage(spark, str(tmp_path / "stage"))
    assert back.exceptAll(panel).isEmpty() and panel.exceptAll(back).isEmpty()
    at = back.select("entity_id", "step", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("k")).orderBy("k").collect()
    for e in range(8):
        mine = [r for r in at if r.entity_id == e]
        assert len({r.file for r in mine}) == 1 and [r.step for r in mine] == list(range(1, 31))


def test_saved_regimes(spark, tmp_path):
    df = spark.createDataFrame([(c + 0.01 * k, c - 0.01 * k) for c in (0.0, 20.0, 42.0) for k in range(5)], "op1 double, op2 double")
    model = regimes.fit_regimes(df, k=3, restarts=2)
    regimes.save_regimes(model, str(tmp_path / "regimes"))
    again = regimes.load_regimes(str(tmp_path / "regimes"))
    centres = lambda m: [[float(x) for x in c] for c in m.clusterCenters()]
    assert centres(again) == centres(model)
    assert regimes.assign_regimes(df, centres(again)).select("op_cluster").distinct().count() == 3


def test_weighted_settings_cost_as_much_as_all_rows(spark):
    """Few settings with very different numbers of rows: the weighted fit's cost is that of its centres over all rows, and
    no worse than a fit on the rows themselves."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(1)
    places = rng.uniform(0, 1, (9, 2)).round(2)
    rows = [tuple(map(float, places[k])) for k in range(9) for _ in range(int(rng.integers(1, 400)))]
    df = spark.createDataFrame(rows, "op1 double, op2 double").repartition(3)
    model = regimes.fit_regimes(df, k=4, restarts=6)
    centres = np.array(model.clusterCenters())
    cost = sum(((np.array(r) - centres) ** 2).sum(1).min() for r in rows)
    assert np.isclose(model.summary.trainingCost, cost)
    plain = [KMeans(k=4, seed=42 + r, featuresCol="v").fit(VectorAssembler(inputCols=["op1", "op2"], outputCol="v").transform(df)).summary.trainingCost for r in range(6)]
    assert cost <= min(plain) * 1.0001 + 1e-9
    assert regimes.weighted_settings(df).count() == len(set(rows))


def test_truth_lines_over_several_splits_and_files(spark, tmp_path):
    """A file in many splits, with blank lines and both kinds of line ends, and a folder of two files."""
    from panelspark.sources import text

    values = [(k * 37) % 101 for k in range(4000)]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.txt").write_text("\n\n" + "".join(f"{v}{' ' if k % 5 else ''}\r\n{chr(10) if k % 9 == 0 else ''}" for k, v in enumerate(values[:3000])))
    (tmp_path / "one" / "b.txt").write_text("\n".join(map(str, values[3000:])))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        truth = text.read_truth_text(spark, f"{tmp_path}/one")
        assert truth.rdd.getNumPartitions() >= 1 and spark.read.text(f"{tmp_path}/one").rdd.getNumPartitions() > 5
        rows = sorted((r.ordinal, r.rul_last) for r in truth.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == list(enumerate(values, 1))


def test_walk_forward_begins_after_the_share_as_written(spark):
    """90 rows at 0.7: the first 63 are known, though 90 * 0.7 is 62.99 in doubles."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(rng.normal(size=90), 1)], "entity_id long, step int, s1 double")
    walks = [forecast.persistence_walk_forward(df, "s1", spec=ONE), *(forecast.walk_forward(df, "s1", o, spec=ONE) for o in ((1, 0, 0), (1, 0, 1)))]
    for out in walks:
        assert sorted(r.step for r in out.collect()) == list(range(64, 91))
