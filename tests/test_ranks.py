import numpy as np
from pyspark.sql import functions as F

from panelspark.operators import intervals, windows
from panelspark.operators.ranks import exact_quantiles, running_totals


def test_quantiles_equal_numpy_with_ties_nulls_and_a_null_group(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.integers(0, 9, 3000)] + [(None, float(v)) for v in rng.normal(size=101)] + [("one", 4.0), ("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = {(r.g, r.q): r.value for r in exact_quantiles(df, ["g"], "v", qs).collect()}
    assert len(got) == 3 * len(qs)
    for g in ("hot", None, "one"):
        want = np.quantile([v for k, v in rows if k == g and v is not None], qs)
        assert np.allclose([got[g, q] for q in qs], want)
    whole = {r.q: r.value for r in exact_quantiles(df, [], F.col("v") * 2, [0.5]).collect()}
    assert np.isclose(whole[0.5], 2 * np.median([v for _, v in rows if v is not None]))
    assert exact_quantiles(df.limit(0), [], "v", [0.5]).count() == 0


def test_running_totals_number_rows_over_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 7 == 0).cast("int").alias("g"), ((F.col("id") * 7919) % 5003).alias("o"))
    rows = running_totals(df, ["g"], ["o"], F.lit(1)).collect()
    for g in (0, 1):
        mine = sorted((r.o, r.upto, r.total) for r in rows if r.g == g)
        assert [m[1] for m in mine] == list(range(1, len(mine) + 1)) and {m[2] for m in mine} == {len(mine)}


def test_smoothing_over_blocks_equals_one_window(spark, monkeypatch):
    monkeypatch.setattr(windows, "SMOOTHED", 4)  # narrower than the frame
    df = spark.range(60).select(F.lit("m").alias("model_name"), "id", F.expr("cast((id * 37) % 60 as double)").alias("true_rul"), F.expr("cast(id * id % 11 as double)").alias("rul_pred")).withColumnRenamed("id", "entity_id")
    rows = sorted(windows.sorted_smoothing(df, 10).collect(), key=lambda r: r.place)
    pred = [p for _, p in sorted((r.true_rul, r.rul_pred) for r in df.collect())]
    assert [r.place for r in rows] == list(range(1, 61))
    assert np.allclose([r.smooth for r in rows], [np.mean(pred[max(0, k - 5) : k + 5]) for k in range(60)])


def test_margin_takes_the_upper_score_on_request(spark):
    df = spark.createDataFrame([("m", 0.0, 1.0, float(k)) for k in range(9)], "model_name string, lower_bound double, upper_bound double, true_rul double")
    scores = np.sort(np.maximum(np.arange(9) - 1.0, 0))
    level = min(np.ceil(10 * 0.75) / 9, 1.0)
    for interpolate, method in ((True, "linear"), (False, "higher")):
        delta = intervals.conformal_margin(df, (0.75,), interpolate).first().delta
        assert np.isclose(delta, np.quantile(scores, level, method=method))


def test_pinball_booster_moves_leaves_to_quantiles(spark):
    from panelspark.operators.learn import fit_boosted

    rng = np.random.default_rng(5)
    rows = [([float(k % 2)], 50.0 * (k % 2) + float(v)) for k, v in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame(rows, "features array<double>, label double")
    model, history = fit_boosted(df, df, loss="pinball", q=0.9, rounds=2, depth=1, rate=1.0)
    losses = [(r.round, r.train) for r in history.orderBy("round").collect()]
    at = {k: np.quantile([y for x, y in rows if x[0] == k], 0.9) for k in (0.0, 1.0)}
    want = np.mean([max(0.9 * (y - at[x[0]]), -0.1 * (y - at[x[0]])) for x, y in rows])
    assert [r for r, _ in losses] == [1, 2] and np.isclose(losses[0][1], want)


def test_quantiles_write_nothing_and_rank_brackets_only(spark):
    """Many distinct values: the ranked cells are a small share, quantiles are numpy's, and no table is written."""
    import glob

    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(size=60000), np.full(20000, 0.25), [np.inf, -np.inf]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    qs = [0.0, 0.001, 0.25, 0.5, 0.7501, 0.99, 1.0]
    out = exact_quantiles(df, [], "v", qs, accuracy=1000)
    got = {r.q: r.value for r in out.collect()}
    want = dict(zip(qs, np.quantile(values, qs), strict=True)) | {0.0: -np.inf, 1.0: np.inf}
    assert all(got[q] == want[q] if np.isinf(want[q]) else np.isclose(got[q], want[q], rtol=0, atol=1e-12) for q in qs), (got, want)
    assert set(glob.glob(f"{folder}/*")) == before
    two = exact_quantiles(spark.createDataFrame([(1, 3.0), (1, 4.0), (None, 5.0)], "g int, v double"), ["g"], "v", [0.5, 0.75])
    assert {(r.g, r.q): r.value for r in two.collect()} == {(1, 0.5): 3.5, (1, 0.75): 3.75, (None, 0.5): 5.0, (None, 0.75): 5.0}


def test_boosting_reads_its_rows_once(spark):
    """Rounds take rows from what was written, and don't compute the windows again."""
    from panelspark.operators.learn import fit_boosted

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([([float(k % 7), float(k % 3)], float(k % 40)) for k in range(200)], "features array<double>, label double")
    valid = rows.limit(50).localCheckpoint()
    model, history = fit_boosted(rows.mapInArrow(counted, rows.schema), valid, rounds=7)
    assert read.value == 200 and history.count() == 7 and len(model["trees"]) <= 7


def test_boosting_keeps_wide_rows_on_disk_in_small_batches(spark, monkeypatch):
    """Spark's cache holds none of the rows in memory, and their batches are small; all of it is let go at the end."""
    from panelspark.operators import learn

    context, seen = spark.sparkContext, []
    fit, known, size = learn.R.DecisionTreeRegressor.fit, set(context._jsc.getPersistentRDDs()), spark.conf.get("spark.sql.inMemoryColumnarStorage.batchSize")

    def spied(self, rows):
        tree = fit(self, rows)
        kept = {i: r for i, r in context._jsc.getPersistentRDDs().items() if i not in known}
        stored = [x for x in context._jsc.sc().getRDDStorageInfo() if x.id() in kept]
        seen.append((sum(x.memSize() for x in stored), sum(x.diskSize() for x in stored), sum(r.count() for r in kept.values())))
        return tree

    monkeypatch.setattr(learn.R.DecisionTreeRegressor, "fit", spied)
    rows = spark.createDataFrame([([float(k % 7), float(k % 3)], float(k % 40)) for k in range(5000)], "features array<double>, label double").coalesce(1)
    learn.fit_boosted(rows, rows.where("label < 2"), rounds=6)
    assert len(seen) == 6 and all(memory == 0 and disk > 0 and batches >= 10 for memory, disk, batches in seen)
    assert spark.conf.get("spark.sql.inMemoryColumnarStorage.batchSize") == size


def test_outlier_bounds_do_not_sort_rows_by_their_few_groups(spark):
    from panelspark.operators.quality import outlier_bounds
    from panelspark.spec import PanelSpec

    rng = np.random.default_rng(8)
    rows = [("hot" if k % 9 else None, float(v)) for k, v in enumerate(rng.normal(size=500))]
    df = spark.createDataFrame(rows, "regime string, s1 double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sizes that Spark knows decide nothing
    try:
        out = outlier_bounds(df, 0.2, PanelSpec(sensors=("s1",)))
        plan = out._jdf.queryExecution().executedPlan().toString()
        row = out.first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    quarters = [np.quantile([v for g, v in rows if g == x], [0.25, 0.75]) for x in ("hot", None)]
    assert np.isclose(row.lo, min(a - 0.2 * (b - a) for a, b in quarters)) and np.isclose(row.hi, max(b + 0.2 * (b - a) for a, b in quarters))
