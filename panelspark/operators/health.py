"""A one-dimensional health index: choice of sensors, fit, application, diagnostics and failure threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.metrics import top_sensors
from panelspark.operators.quality import by_sensor, safe_corr
from panelspark.operators.ranges import MOST_ROWS, RANGE, in_range_order, known_long, map_runs
from panelspark.operators.ranks import exact_quantiles
from panelspark.operators.regimes import regime_parameters, small
from panelspark.spec import END_OF_LIFE, PanelSpec

P = PanelSpec()


def degradation_corr(df: DataFrame, threshold: float = 0.5, spec: PanelSpec = P) -> DataFrame:
    """R of each sensor with -RUL, and whether |r| reaches the threshold."""
    r = by_sensor(df, spec.sensors, r=lambda c: F.bround(safe_corr(c, -F.col(spec.rul)), 4))
    return r.withColumn("kept", F.coalesce(F.abs("r") >= threshold, F.lit(False)))


def covariance(df: DataFrame, columns) -> np.ndarray:
    """Sample covariance, a few numbers from one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"c{i}_{j}"] or 0.0
    return out


def _detrended(df: DataFrame, means: DataFrame, columns, regime: str) -> DataFrame:
    joined = df.join(small(means), regime)
    return joined.withColumns({f"_d_{c}": F.col(c) - F.col(f"{c}_mean") for c in columns})


def preferred_columns(df: DataFrame, sensors, window: int = 10) -> list[str]:
    """Rolling means where all are there, else the sensors themselves."""
    smooth = [f"{s}_rmean_{window}" for s in sensors]
    return smooth if all(c in df.columns for c in smooth) else list(sensors)


def fit_health_index(train: DataFrame, spec: PanelSpec = P, window: int = 10, components: int = 1, threshold: float = 0.5) -> dict[str, DataFrame]:
    """H6: tables `means` (regime means), `weights` (component, column, weight) and `scale` (mu, sd) of an index that rises with wear.

    Columns are detrended by train regime means, kept where |r| with -RUL reaches the threshold, and projected on the
    leading eigenvectors of their covariance, each with the sign of positive correlation; two components are combined by the larger.
    """
    spark = train.sparkSession
    columns = preferred_columns(train, spec.sensors, window)
    means = regime_parameters(train, columns, spec.regime).select(spec.regime, *[f"{c}_mean" for c in columns])
    flat = _detrended(train, means, columns, spec.regime)
    r = {x.sensor: x.r for x in by_sensor(flat, [f"_d_{c}" for c in columns], r=lambda c: safe_corr(c, -F.col(spec.rul))).collect()}
    kept = [c for c in columns if r[f"_d_{c}"] is not None and abs(r[f"_d_{c}"]) >= threshold]
    if not kept:
        raise ValueError("no sensor reaches the correlation threshold")
    values, vectors = np.linalg.eigh(covariance(flat, [f"_d_{c}" for c in kept]))
    vectors = vectors[:, np.argsort(-values)][:, :components]
    score = [sum((float(w) * F.col(f"_d_{c}") for w, c in zip(v, kept, strict=True)), F.lit(0.0)) for v in vectors.T]
    signs = flat.agg(*[safe_corr(s, -F.col(spec.rul)).alias(f"k{k}") for k, s in enumerate(score)]).first()
    rows = [(k, c, float(w) * (-1.0 if (signs[f"k{k}"] or 0) < 0 else 1.0)) for k, v in enumerate(vectors.T) for w, c in zip(v, kept, strict=True)]
    weights = spark.createDataFrame(rows, "component int, column string, weight double")
    raw = _raw_index(flat, rows)
    scale = flat.agg(F.avg(raw).alias("mu"), F.stddev_samp(raw).alias("sd"))
    return {"means": means, "weights": weights, "scale": scale}


def _raw_index(df: DataFrame, rows) -> Column:
    parts: dict[int, Column] = {}
    for k, c, w in rows:
        term = F.lit(w) * F.col(f"_d_{c}")
        parts[k] = parts[k] + term if k in parts else term
    scores = list(parts.values())
    return scores[0] if len(scores) == 1 else F.greatest(*scores)


def apply_health_index(df: DataFrame, fitted: dict[str, DataFrame], spec: PanelSpec = P) -> DataFrame:
    """H7: the index on any rows, by train parameters only."""
    rows = [(r.component, r.column, r.weight) for r in fitted["weights"].collect()]  # sensors x components
    columns = list(dict.fromkeys(c for _, c, _ in rows))
    flat = _detrended(df, fitted["means"].select(spec.regime, *[f"{c}_mean" for c in columns]), columns, spec.regime)
    flat = flat.withColumn("_raw", _raw_index(flat, rows)).crossJoin(F.broadcast(fitted["scale"]))  # one row
    index = F.when(F.col("sd") > 1e-6, (F.col("_raw") - F.col("mu")) / F.col("sd")).otherwise(F.col("_raw") - F.col("mu"))
    return flat.select(*df.columns, index.alias("health_index"))


def pca_diagnostics(train: DataFrame, spec: PanelSpec = P) -> DataFrame:
    """H8: share and cumulated share of variance of each component of the detrended sensors, its r with -RUL and its loadings."""
    means = regime_parameters(train, spec.sensors, spec.regime).select(spec.regime, *[f"{c}_mean" for c in spec.sensors])
    flat = _detrended(train, means, spec.sensors, spec.regime)
    values, vectors = np.linalg.eigh(covariance(flat, [f"_d_{c}" for c in spec.sensors]))
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    scores = [sum((float(w) * F.col(f"_d_{c}") for w, c in zip(v, spec.sensors, strict=True)), F.lit(0.0)) for v in vectors.T]
    r = flat.agg(*[safe_corr(s, -F.col(spec.rul)).alias(f"k{k}") for k, s in enumerate(scores)]).first()
    share = values / max(values.sum(), 1e-12)
    rows = [(k + 1, float(share[k]), float(share[: k + 1].sum()), r[f"k{k}"], {s: float(x) for s, x in zip(spec.sensors, vectors[:, k], strict=True)}) for k in range(len(values))]
    return train.sparkSession.createDataFrame(rows, "component int, share double, cumulative double, r double, loadings map<string,double>")


def threshold_sensitivity(train: DataFrame, thresholds=tuple(k / 20 for k in range(15)), spec: PanelSpec = P) -> DataFrame:
    """H9: the first component's share of variance for sensors kept at each threshold; null below two sensors."""
    r = {x.sensor: abs(x.r or 0.0) for x in degradation_corr(train, 0.0, spec).collect()}
    c = covariance(train, list(spec.sensors))
    rows = []
    for t in thresholds:
        k = [i for i, s in enumerate(spec.sensors) if r[s] >= t]
        v = np.linalg.eigvalsh(c[np.ix_(k, k)]) if len(k) > 1 else None
        rows.append((float(t), len(k), float(v[-1] / max(v.sum(), 1e-12)) if v is not None else None))
    return train.sparkSession.createDataFrame(rows, "threshold double, sensors int, share double")


def top5_mean_index(scaled: DataFrame, k: int = 5, spec: PanelSpec = P) -> DataFrame:
    """The mean of the k scaled sensors of largest |r| with -RUL, the ablation's plain index."""
    names = [r.sensor for r in top_sensors(degradation_corr(scaled, 0.0, spec), k).collect()]
    return scaled.withColumn("health_index", sum((F.col(s) for s in names), F.lit(0.0)) / len(names))


def health_index_r2(df: DataFrame, index: str = "health_index", spec: PanelSpec = P) -> DataFrame:
    """R2 of the index as a prediction of -RUL."""
    y = -F.col(spec.rul)
    return df.agg((1 - F.sum((y - F.col(index)) ** 2) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"))


def ablation_table(variants: list[tuple[str, str, DataFrame]], metric: str, smaller_is_better: bool = True) -> DataFrame:
    """(component, variant, metric, delta to the component's first variant, verdict); each variant's table has one row."""
    out = None
    for k, (component, variant, df) in enumerate(variants):
        row = df.select(F.lit(k).alias("_k"), F.lit(component).alias("component"), F.lit(variant).alias("variant"), F.col(metric).cast("double").alias("metric"))
        out = row if out is None else out.unionByName(row)
    base = out.groupBy("component").agg(F.min_by("metric", "_k").alias("_base"))
    d = F.col("metric") - F.col("_base")
    better = d < 0 if smaller_is_better else d > 0
    verdict = F.when(F.abs(d) < 0.01, "negligible").when(better, "better").otherwise("worse")
    return out.join(base, "component").select("component", "variant", "metric", d.alias("delta"), verdict.alias("verdict"))


def pooled_blocks(y: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(means, sizes) of the blocks of the least-squares fit that never falls; sizes count values, of whatever weight."""
    blocks: list[list[float]] = []
    for v, w in zip(y.tolist(), [1.0] * len(y) if weights is None else weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.array([b[0] for b in blocks], float), np.array([b[2] for b in blocks], int)


def pool_adjacent_violators(y: np.ndarray) -> np.ndarray:
    """The least-squares fit that never falls."""
    return np.repeat(*pooled_blocks(y))


def isotonic_index(df: DataFrame, index: str = "health_index", spec: PanelSpec = P, most: int | None = MOST_ROWS) -> DataFrame:
    """Each entity's index made monotone.

    Every range of a long entity pools its own rows. A block of one range can only be pooled with others if its mean is
    above the least mean with which a later range begins, or below the largest with which an earlier one ends. Such
    blocks, as (mean, rows), meet by entity and are pooled until none falls; all others are final. Rows take the mean of
    their block by a join on the block.
    """
    kind = df.schema[spec.entity].dataType.simpleString()
    most = known_long(df, spec, most)
    rows = in_range_order(df.select(spec.entity, spec.step, F.col(index).cast("double").alias(index)), spec, most)
    keys = [spec.entity, RANGE]

    def fit(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        means, sizes = pooled_blocks(c[index])
        columns = [pa.array(c[spec.entity]), *(pa.array(c[x]) for x in (RANGE, spec.step, index)), pa.array(np.repeat(np.arange(len(sizes)), sizes)), pa.array(np.repeat(means, sizes))]
        return pa.record_batch(columns, names=[*keys, spec.step, index, "_block", "_mean"])

    schema = f"`{spec.entity}` {kind}, {RANGE} int, `{spec.step}` {df.schema[spec.step].dataType.simpleString()}, `{index}` double, _block bigint, _mean double"
    placed = map_runs(rows.drop("_cuts"), keys, spec.step, fit, schema)
    if most is None:
        return placed.select(spec.entity, spec.step, index, F.col("_mean").alias("isotonic"))
    long = map_runs(rows.where(F.col("_cuts").isNotNull()).drop("_cuts"), keys, spec.step, fit, schema)
    blocks = long.groupBy(*keys, "_block").agg(F.first("_mean").alias("_mean"), F.count(F.lit(1)).cast("double").alias("_w"))
    ends = blocks.groupBy(*keys).agg(F.min_by("_mean", "_block").alias("_begin"), F.max_by("_mean", "_block").alias("_end"))
    order = Window.partitionBy(spec.entity).orderBy(RANGE)
    after = F.min("_begin").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after")
    before = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before")
    loose = blocks.join(ends.select(*keys, after, before), keys).where((F.col("_mean") > F.col("_after")) | (F.col("_mean") < F.col("_before")))

    def pool(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        means, sizes = pooled_blocks(c["_mean"], c["_w"])
        return pa.record_batch([pa.array(c[spec.entity]), pa.array(c[RANGE]), pa.array(c["_block"]), pa.array(np.repeat(means, sizes))], names=[*keys, "_block", "_pooled"])

    place = (F.col(RANGE).cast("bigint") * 2**40 + F.col("_block")).alias("_place")
    pooled = map_runs(loose.select(*keys, "_block", "_mean", "_w", place), [spec.entity], "_place", pool, f"`{spec.entity}` {kind}, {RANGE} int, _block bigint, _pooled double")
    return placed.join(pooled, [*keys, "_block"], "left").select(spec.entity, spec.step, index, F.coalesce("_pooled", "_mean").alias("isotonic"))


def failure_threshold(train: DataFrame, q: float = 0.05, end_of_life: int = END_OF_LIFE, index: str = "health_index", spec: PanelSpec = P) -> DataFrame:
    """The q-quantile of the index near the end of life."""
    return exact_quantiles(train.where(F.col(spec.rul) <= end_of_life), [], index, [q]).agg(F.max("value").alias("threshold"))  # one row, also of none


def hi_regressor(train: DataFrame, index: str = "health_index", spec: PanelSpec = P) -> DataFrame:
    """RUL on the index by least squares, over the rows from the max(1, int(0.4 n))-th on (counted from 0) of each entity."""
    k, n = F.row_number().over(spec.ordered()) - 1, F.count(F.lit(1)).over(spec.whole())
    rows = train.withColumn("_k", k).withColumn("_n", n).where(F.col("_k") >= F.greatest(F.floor(F.col("_n") * 0.4), F.lit(1)))
    y, x = F.col(spec.rul).cast("double"), F.col(index)
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
