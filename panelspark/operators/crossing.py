"""Remaining life from when a health index reaches its threshold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalars import clip
from panelspark.operators.intervals import repair_bounds
from panelspark.operators.metrics import evaluate
from panelspark.operators.ranks import exact_quantiles
from panelspark.spec import RUL_CAP, PanelSpec

P = PanelSpec()
FLAT = 1e-4


def observed(df: DataFrame, index: str = "health_index", spec: PanelSpec = P, short_share: bool = False) -> DataFrame:
    """One row for each entity: n, last index, its slopes over the long and the short tail, and the label at the last row.

    The long tail is the last max(5, min(30, int(0.2 n))) rows; the short one max(5, min(15, n div 4)), or with
    short_share (I10) int(0.2 n).
    """
    k = F.row_number().over(Window.partitionBy(spec.entity).orderBy(F.desc(spec.step)))
    rows = df.withColumn("_k", k).withColumn("_n", F.count(F.lit(1)).over(spec.whole()))
    fifth = F.floor(F.col("_n") * 0.2)
    long = F.greatest(F.least(fifth, F.lit(30)), F.lit(5))
    short = F.greatest(fifth, F.lit(1)) if short_share else F.greatest(F.least(F.floor(F.col("_n") / 4), F.lit(15)), F.lit(5))
    slope = lambda tail: F.regr_slope(F.when(F.col("_k") <= tail, F.col(index)), F.col(spec.step).cast("double"))
    label = [F.max_by(spec.rul, spec.step).alias("true_rul")] if spec.rul in df.columns else []
    return rows.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("n"), F.max_by(index, spec.step).alias("last"), slope(long).alias("slope_long"), slope(short).alias("slope_short"), *label)


def extrapolate(slope: Column, threshold: Column, cap: int, fallback: Column) -> Column:
    """(threshold - last) / slope within [0, cap]; the fallback for short or flat histories."""
    flat = (F.col("n") < 3) | (F.coalesce(slope, F.lit(0.0)) <= FLAT)
    return F.when(flat, fallback).otherwise(clip((threshold - F.col("last")) / F.nullif(slope, F.lit(0.0)), 0.0, float(cap)))


def with_parameters(obs: DataFrame, threshold: DataFrame, regressor: DataFrame | None, cap: int) -> DataFrame:
    """obs with `threshold` and `fallback`: the regressor's estimate at the last index, or the cap. Both tables have one row."""
    out = obs.crossJoin(F.broadcast(threshold.select("threshold")))
    if regressor is None:
        return out.withColumn("fallback", F.lit(float(cap)))
    out = out.crossJoin(F.broadcast(regressor.select("slope", "intercept")))
    return out.withColumn("fallback", F.coalesce(clip(F.col("intercept") + F.col("slope") * F.col("last"), 0.0, float(cap)), F.lit(float(cap)))).drop("slope", "intercept")


def linear_extrapolation(obs: DataFrame, spec: PanelSpec = P) -> DataFrame:
    """I9 for each entity."""
    return obs.withColumn("rul_linear", extrapolate(F.col("slope_long"), F.col("threshold"), spec.cap, F.col("fallback")))


def as_paths(path: DataFrame, spec: PanelSpec = P) -> DataFrame:
    """Paths with a row for each entity and an array for each value; rows (entity, at, ...) are gathered by entity."""
    if "at" not in path.columns:
        return path
    values = [c for c in path.columns if c not in (spec.entity, "at")]
    sorted_rows = F.array_sort(F.collect_list(F.struct("at", *values)))
    return path.groupBy(spec.entity).agg(sorted_rows.alias("_p")).select(spec.entity, *[F.col(f"_p.{c}").alias(c) for c in values])


def _met(values: Column, threshold: Column) -> Column:
    """Place, from 0 on, of the first value at or above the threshold; null if there is none."""
    return F.nullif(F.array_position(F.transform(values, lambda x: F.coalesce(x >= threshold, F.lit(False))), True), F.lit(0)) - 1


def first_crossing(path: DataFrame, obs: DataFrame, spec: PanelSpec = P, least: int = 3) -> DataFrame:
    """The first 0-based step of the path at or above the threshold, at least `least`; null if there is none."""
    met = _met(F.col("mean"), F.col("threshold")).cast("int")
    joined = as_paths(path, spec).join(obs.select(spec.entity, "threshold"), spec.entity)
    return joined.select(spec.entity, F.greatest(met, F.when(met.isNotNull(), F.lit(least))).alias("crossing"))


def _rul_of_path(v: Column, cap: int, plain: bool) -> Column:
    """Remaining life from a path's values and the facts of obs beside them."""
    t = F.col("threshold")
    fallback = F.lit(float(cap)) if plain else F.col("fallback")
    ok = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    first = F.slice(v, 1, 30)
    n = F.size(first).cast("double")
    products = F.aggregate(F.transform(first, lambda x, k: (k - (n - 1) / 2) * x), F.lit(0.0), lambda a, x: a + x)
    slope = products / F.nullif(n * (n * n - 1) / 12, F.lit(0.0))
    meets = 30 + (t - F.get(v, F.lit(29))) / F.nullif(slope, F.lit(0.0))
    met = _met(v, t)
    long = extrapolate(F.col("slope_long"), t, cap, fallback)
    return (
        F.when(~ok, long)
        .when(F.col("last") >= t, extrapolate(F.col("slope_short"), t, cap, fallback))
        .when(met.isNotNull(), F.greatest(met, F.lit(3)).cast("double"))
        .when((slope > FLAT) & (meets <= 200), clip(meets, 0.0, float(cap)))
        .otherwise(long)
    )


def rul_from_forecast(path: DataFrame, obs: DataFrame, value: str = "mean", spec: PanelSpec = P, plain: bool = False, name: str = "rul_pred") -> DataFrame:
    """I8: remaining life from forecast paths (a row and arrays for each entity, or rows (entity, at, value)) and obs.

    In order: no path or a value that isn't finite: the long tail's line. Already past the threshold: the short tail's.
    The first crossing, at least 3. The line of the path's first 30 steps, if it rises and meets the threshold within
    200. Else the long tail's line. plain (I10): past the threshold and flat gives the cap.
    """
    both = obs.join(as_paths(path, spec).select(spec.entity, F.col(value).alias("_v")), spec.entity, "left")
    return both.withColumn(name, _rul_of_path(F.col("_v"), spec.cap, plain)).drop("_v")


def velocity_ceiling(df: DataFrame, columns=("rul_pred", "lower_bound"), linear: str = "rul_linear") -> DataFrame:
    """No more than max(1.5 times the linear estimate, 5)."""
    top = F.greatest(F.col(linear) * 1.5, F.lit(5.0))
    return df.withColumns({c: F.least(F.col(c), top) for c in columns})


def bounds_from_bands(path: DataFrame, obs: DataFrame, spec: PanelSpec = P, how: str = "left") -> DataFrame:
    """Point and bounds from paths with bands, met once for all three; the upper band gives the lower bound. Bounds are
    put in order and clipped. how: `inner` leaves out entities without a path."""
    bands = {"mean": "rul_pred", "hi": "lower_bound", "lo": "upper_bound"}
    both = obs.join(as_paths(path, spec).select(spec.entity, *[F.col(c).alias(f"_{c}") for c in bands]), spec.entity, how)
    out = both.withColumns({name: _rul_of_path(F.col(f"_{c}"), spec.cap, False) for c, name in bands.items()})
    return repair_bounds(out.drop(*[f"_{c}" for c in bands]), spec.cap)


def with_fallback(entities: DataFrame, predictions: DataFrame, spec: PanelSpec = P) -> DataFrame:
    """Entities without a prediction get their linear estimate with bounds over the whole range."""
    out = entities.join(predictions.select(spec.entity, "rul_pred", "lower_bound", "upper_bound"), spec.entity, "left")
    none = F.col("rul_pred").isNull()
    return out.withColumns({
        "rul_pred": F.coalesce("rul_pred", "rul_linear"),
        "lower_bound": F.when(none, F.lit(0.0)).otherwise(F.col("lower_bound")),
        "upper_bound": F.when(none, F.lit(float(spec.cap))).otherwise(F.col("upper_bound")),
    })


#: Predictions (entity, rul_pred, lower_bound, upper_bound) from a panel and its observations (a row for each entity).
Predictor = Callable[[DataFrame, DataFrame], DataFrame]


def line_predictor(spread: float = 0.2) -> Predictor:
    """The linear estimate, with bounds of a share of it on both sides."""

    def predict(df: DataFrame, obs: DataFrame) -> DataFrame:
        r = F.col("rul_linear")
        return obs.withColumns({"rul_pred": r, "lower_bound": r * (1 - spread), "upper_bound": r * (1 + spread)})

    return predict


def forecast_predictor(order=(1, 1, 0), horizon: int = 150, smooth: int = 10, index: str = "health_index", ceiling: bool = True, spec: PanelSpec = P) -> Predictor:
    """Forecast paths of every entity's index, where they and their bands cross the threshold, and the velocity ceiling."""
    from panelspark.operators.forecast import forecast_paths

    def predict(df: DataFrame, obs: DataFrame) -> DataFrame:
        paths = forecast_paths(df, index, order, horizon, smooth, spec=spec).withColumnRenamed("entity_id", spec.entity)
        out = bounds_from_bands(paths, obs, spec, "inner")
        return velocity_ceiling(out) if ceiling else out

    return predict


def predict_fleet(df: DataFrame, threshold: DataFrame, regressor: DataFrame | None = None, factor: float = 1.0, index: str = "health_index", spec: PanelSpec = P, predictor: Predictor | None = None) -> DataFrame:
    """(entity, true_rul, rul_pred, lower_bound, upper_bound) by any predictor, the linear one by default. Entities that
    it gives nothing for get the fallback row (I13); the safety factor is on the point only; bounds are repaired last."""
    obs = linear_extrapolation(with_parameters(observed(df, index, spec), threshold, regressor, spec.cap), spec)
    out = with_fallback(obs, (predictor or line_predictor())(df, obs), spec).withColumn("rul_pred", F.col("rul_pred") * factor)
    keep = [c for c in ("true_rul",) if c in out.columns]
    return repair_bounds(out, spec.cap).select(spec.entity, *keep, "rul_pred", "lower_bound", "upper_bound")


def ensemble_median(long: DataFrame, fallback: DataFrame, spec: PanelSpec = P) -> DataFrame:
    """The median of each entity's finite predictions, else the fallback's."""
    good = long.where(F.col("rul_pred").isNotNull() & ~F.isnan("rul_pred") & (F.abs("rul_pred") != float("inf")))
    middle = good.groupBy(spec.entity).agg(F.percentile("rul_pred", F.lit(0.5)).alias("m"))
    return fallback.join(middle, spec.entity, "left").select(spec.entity, F.coalesce("m", "fallback").alias("rul_pred"))


def threshold_grid(train: DataFrame, cut: DataFrame, quantiles=(0.01, 0.05, 0.1, 0.2, 0.3, 0.5), end_of_life: int = 5, index: str = "health_index", spec: PanelSpec = P) -> DataFrame:
    """Metrics on truncated train histories for each quantile's threshold. Thresholds come from one aggregate, and
    the entities' slopes are found once for all of them."""
    near = train.where(F.col(spec.rul) <= end_of_life)
    values = exact_quantiles(near, [], index, quantiles).select("q", F.col("value").alias("threshold"))
    obs = observed(cut, index, spec).crossJoin(F.broadcast(values)).withColumn("fallback", F.lit(float(spec.cap)))  # a row for each quantile
    return evaluate(linear_extrapolation(obs, spec).withColumn("rul_pred", F.col("rul_linear")), "q", "threshold")


def safety_factor_grid(predictions: DataFrame, factors=(0.75, 0.8, 0.85, 0.88, 0.9, 0.95, 1.0)) -> DataFrame:
    """Metrics for each factor on the point; predictions are made once."""
    both = predictions.withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors])))
    return evaluate(both.withColumn("rul_pred", F.col("rul_pred") * F.col("factor")), "factor")


def linear_paths(obs: DataFrame, horizon: int = 150, spread: float = 0.1, spec: PanelSpec = P) -> DataFrame:
    """Closed-form paths (entity, mean, lo, hi), arrays: the long tail's line, bands growing with the root of the step."""
    ahead = F.sequence(F.lit(1), F.lit(horizon))
    mean = lambda k: F.col("last") + F.coalesce("slope_long", F.lit(0.0)) * k
    band = lambda k: F.lit(spread) * F.sqrt(k)
    lines = {"mean": mean, "lo": lambda k: mean(k) - band(k), "hi": lambda k: mean(k) + band(k)}
    return obs.select(spec.entity, *[F.transform(ahead, f).alias(c) for c, f in lines.items()])


def linear_path(obs: DataFrame, horizon: int = 150, spread: float = 0.1, spec: PanelSpec = P) -> DataFrame:
    """linear_paths as rows (entity, at, mean, lo, hi)."""
    rows = linear_paths(obs, horizon, spread, spec).select(spec.entity, F.posexplode(F.arrays_zip("mean", "lo", "hi")).alias("at", "_v"))
    return rows.select(spec.entity, "at", "_v.mean", "_v.lo", "_v.hi")
