import numpy as np
from pyspark.sql import functions as F

from panelspark.operators import windows
from panelspark.spec import PanelSpec
from panelspark.streaming.features import stream_panel_features


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(e, k, float(rng.normal())) for e in (1, 2, 3) for k in range(1, 46)]
    schema = "entity_id bigint, step int, s1 double"
    df = spark.createDataFrame(rows, schema)
    for n, (lo, hi) in enumerate([(1, 20), (21, 45), (10, 12)]):  # the last file comes late
        df.where(F.col("step").between(lo, hi)).coalesce(1).write.parquet(f"{tmp_path}/in/f{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = stream_panel_features(stream, "s1", windows=(5, 10, 20, 40), threshold=2.0)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.entity_id, r.step): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    spec = PanelSpec(sensors=("s1",))
    want = windows.rolling_median(windows.rolling_features(df, (5, 10, 20, 40), spec=spec), "s1", 10, spec=spec).collect()
    assert len(got) == len(want)
    for (e, step), g in got.items():  # the linear estimate, from the rows so far
        y = [v for x, k, v in rows if x == e and k <= step]
        tail = y[-max(5, min(30, int(0.2 * len(y)))) :]
        slope = np.polyfit(range(len(tail)), tail, 1)[0] if len(tail) > 1 else 0
        want_rul = 125.0 if len(y) < 3 or slope <= 1e-4 else min(max((2.0 - y[-1]) / slope, 0), 125)
        assert abs(g.rul_linear - want_rul) < 1e-6
    for r in want:
        g = got[r.entity_id, r.step]
        for c in ("s1_rmean_5", "s1_rstd_10", "s1_rmean_20", "s1_rmean_40", "s1_rstd_40", "s1_median"):
            assert abs(g[c] - r[c]) < 1e-9


def _run(spark, tmp_path, files, **options):
    """Output rows of a stream that gets the files one by one."""
    schema = "entity_id bigint, step int, s1 double, at timestamp"
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, "entity_id bigint, step int, s1 double, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/in/f{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = stream_panel_features(stream, "s1", windows=(5,), median=3, event_time="at", **options)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("entity_id", "step", "s1_rmean_5", "s1_rstd_5", "late").collect())


def test_watermark_drops_late_rows_and_idle_entities_are_forgotten(spark, tmp_path):
    day = lambda d, h=0: f"2024-01-{d:02d} {h:02d}:00:00"
    files = [
        [(1, 1, 10.0, day(1)), (1, 2, 20.0, day(1, 1)), (2, 1, 1.0, day(1))],
        [(2, 2, 3.0, day(8))],  # the watermark passes day 7: entity 1 has been idle for more than two days
        [(2, 3, 5.0, day(8, 1))],  # a batch's late rows are told by the watermark of the one before
        [(1, 3, 99.0, day(2))],  # behind the watermark
        [(1, 3, 7.0, day(9)), (2, 2, 50.0, day(9))],  # entity 1 begins anew; entity 2's step was there
    ]
    got = _run(spark, tmp_path, files, delay="1 day", idle="2 days")
    assert got[:3] == [(1, 1, 10.0, 0.0, 0), (1, 2, 15.0, got[1][3], 0), (1, 3, 7.0, 0.0, 0)]
    assert [(e, s) for e, s, *_ in got] == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]
    assert 99.0 not in [r[2] for r in got]


def test_features_of_batches_equal_row_by_row(spark):
    from panelspark.streaming.features import batch_features

    rng = np.random.default_rng(2)
    y = np.cumsum(rng.normal(0.1, 1, 90))
    whole = batch_features(np.zeros(0), y, 0, (1, 5, 40), 10, 3.0, 125)
    for cut in (1, 3, 29, 77):
        rest = batch_features(y[:cut][-40:], y[cut:], cut, (1, 5, 40), 10, 3.0, 125)
        for k, v in rest.items():
            assert np.allclose(whole[k][cut:], v), k
    assert np.allclose(whole["rstd_1"], 0) and np.isclose(whole["rstd_5"][60], y[56:61].std(ddof=1)) and np.isclose(whole["median"][4], np.median(y[:5]))
