"""Screening of sensors, outlier bounds, profiles of lifetimes and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.scalars import clip
from panelspark.operators.ranks import exact_quantiles, running_totals
from panelspark.spec import PanelSpec

P = PanelSpec()


def by_sensor(df: DataFrame, sensors, **stats) -> DataFrame:
    """(sensor, stat...) from one aggregate over all sensors; stats: name -> function of a column."""
    row = df.agg(*[f(F.col(s)).alias(f"{s}#{n}") for s in sensors for n, f in stats.items()])
    structs = [F.struct(F.lit(s).alias("sensor"), *[F.col(f"`{s}#{n}`").alias(n) for n in stats]) for s in sensors]
    return row.select(F.inline(F.array(*structs)))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's r; null where a side is constant (corr itself raises then)."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def low_variance_sensors(df: DataFrame, threshold: float = 0.1, spec: PanelSpec = P) -> DataFrame:
    """Sensors whose sample deviation is below the threshold."""
    return by_sensor(df, spec.sensors, sd=F.stddev_samp).where(F.col("sd") < threshold)


def sensor_profile(df: DataFrame, spec: PanelSpec = P, dead: float = 1e-10, low: float = 0.1) -> DataFrame:
    """Variance, correlation with the label, and what to do with the sensor."""
    out = by_sensor(df, spec.sensors, variance=F.var_samp, corr_rul=lambda c: safe_corr(c, F.col(spec.rul)))
    return out.withColumn("decision", F.when(F.col("variance") < dead, "drop").when(F.col("variance") < low, "borderline").otherwise("keep"))


def drop_sensor_decision(train: DataFrame, test: DataFrame, threshold: float = 0.1, spec: PanelSpec = P) -> DataFrame:
    """Sensors found on train alone, and where they are present."""
    found = low_variance_sensors(train, threshold, spec).select("sensor")
    return found.select("sensor", F.col("sensor").isin(train.columns).alias("in_train"), F.col("sensor").isin(test.columns).alias("in_test"))


def drop_sensors(train: DataFrame, test: DataFrame, threshold: float = 0.1, spec: PanelSpec = P) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both panels without them, and the decisions (one row a sensor)."""
    table = drop_sensor_decision(train, test, threshold, spec)
    names = [r.sensor for r in table.collect()]
    return train.drop(*names), test.drop(*names), table


def lifetimes(df: DataFrame, spec: PanelSpec = P) -> DataFrame:
    return df.groupBy(spec.entity).agg(F.max(spec.step).cast("int").alias("lifetime"))


def lifetime_profile(df: DataFrame, spec: PanelSpec = P) -> DataFrame:
    """D3: the distribution of lifetimes, and whether all exceed the cap."""
    q = lambda p, n: F.percentile("lifetime", F.lit(p)).alias(n)
    return lifetimes(df, spec).agg(F.count(F.lit(1)).alias("entities"), F.avg("lifetime").alias("mean"), F.stddev_samp("lifetime").alias("sd"), F.min("lifetime").alias("least"), q(0.25, "q25"), q(0.5, "q50"), q(0.75, "q75"), F.max("lifetime").alias("most"), (F.min("lifetime") > spec.cap).alias("cap_binds"))


def representative_entities(df: DataFrame, spec: PanelSpec = P) -> DataFrame:
    """The shortest, the middle and the longest lifetime; entities are ranked over range partitions."""
    ranked = running_totals(lifetimes(df, spec), [], ["lifetime", spec.entity], F.lit(1))
    k, n = F.col("upto"), F.col("total")
    role = F.when(k == 1, "shortest").when(k == F.floor(n / 2) + 1, "median").when(k == n, "longest")
    return ranked.withColumn("role", role).where("role is not null").select(spec.entity, "lifetime", "role")


def dataset_summary(predictions: DataFrame, by: str, truth: str) -> DataFrame:
    """Count, mean, population deviation and range of a truth column."""
    return predictions.groupBy(by).agg(F.count(truth).alias("n"), F.avg(truth).alias("mean"), F.stddev_pop(truth).alias("sd"), F.min(truth).alias("least"), F.max(truth).alias("most"))


def std_within_vs_overall(df: DataFrame, spec: PanelSpec = P) -> DataFrame:
    """A sensor's deviation over all rows, and the mean of its deviations within regimes."""
    within = df.groupBy(spec.regime).agg(*[F.stddev_samp(s).alias(s) for s in spec.sensors])
    return by_sensor(df, spec.sensors, overall=F.stddev_samp).join(by_sensor(within, spec.sensors, within=F.avg), "sensor")


def outlier_bounds(train: DataFrame, n_iqr: float = 5.0, spec: PanelSpec = P, group: str | None = "regime", approx: int | None = None) -> DataFrame:
    """(sensor, lo, hi), the union over regimes of quartiles widened by n_iqr quartile distances. Exact quartiles
    come from ranks dealt over tasks, whatever a regime's size; approx: accuracy of approximate ones, in one pass."""
    by = [group] if group else []
    if approx:
        grouped = train.groupBy(*by).agg(*[F.percentile_approx(s, [0.25, 0.75], approx).alias(s) for s in spec.sensors])
    else:
        long = train.select(*by, F.inline(F.array(*[F.struct(F.lit(s).alias("sensor"), F.col(s).cast("double").alias("v")) for s in spec.sensors])))
        quartile = lambda s, k: F.max(F.when((F.col("sensor") == s) & (F.col("k") == k), F.col("value")))
        grouped = exact_quantiles(long, [*by, "sensor"], "v", [0.25, 0.75], few=True).groupBy(*by).agg(*[F.array(quartile(s, 0), quartile(s, 1)).alias(s) for s in spec.sensors])
    edge = lambda s, sign: F.col(s)[0 if sign < 0 else 1] + sign * n_iqr * (F.col(s)[1] - F.col(s)[0])
    wide = grouped.agg(*[f(edge(s, sign)).alias(f"{s}#{n}") for s in spec.sensors for n, sign, f in (("lo", -1, F.min), ("hi", 1, F.max))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(s).alias("sensor"), F.col(f"`{s}#lo`").alias("lo"), F.col(f"`{s}#hi`").alias("hi")) for s in spec.sensors])))


def wide_parameters(table: DataFrame, names, values, key: str = "sensor") -> DataFrame:
    """One row of columns name_value from a table with a row for each name."""
    return table.agg(*[F.max(F.when(F.col(key) == n, F.col(v))).alias(f"{n}_{v}") for n in names for v in values])


def clip_outliers(df: DataFrame, bounds: DataFrame, spec: PanelSpec = P) -> DataFrame:
    """Sensors clipped to their bounds; n_clipped tells how many of a row's values were."""
    joined = df.crossJoin(F.broadcast(wide_parameters(bounds, spec.sensors, ("lo", "hi"))))  # one row of bounds
    out = {s: clip(F.col(s), F.col(f"{s}_lo"), F.col(f"{s}_hi")) for s in spec.sensors}
    moved = sum((F.coalesce((F.col(s) < F.col(f"{s}_lo")) | (F.col(s) > F.col(f"{s}_hi")), F.lit(False)).cast("int") for s in spec.sensors), F.lit(0))
    return joined.withColumn("n_clipped", moved).withColumns(out).select(*df.columns, "n_clipped")


def dead_sensors(df: DataFrame, spec: PanelSpec = P) -> DataFrame:
    """Sensors that are constant in some regime, with the number of such regimes."""
    per = df.groupBy(spec.regime).agg(*[F.stddev_samp(s).alias(s) for s in spec.sensors])
    return by_sensor(per, spec.sensors, regimes=lambda c: F.count_if(c == 0)).where("regimes > 0")


def scaling_violations(scaled: DataFrame, tolerance: float = 0.05, spec: PanelSpec = P) -> DataFrame:
    """(regime, sensor) whose mean is off zero or whose deviation is zero."""
    per = scaled.groupBy(spec.regime).agg(*[f(s).alias(f"{s}#{n}") for s in spec.sensors for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    long = per.select(spec.regime, F.inline(F.array(*[F.struct(F.lit(s).alias("sensor"), F.col(f"`{s}#mean`").alias("mean"), F.col(f"`{s}#sd`").alias("sd")) for s in spec.sensors])))
    return long.where((F.abs("mean") >= tolerance) | (F.col("sd") <= 0))


def label_integrity(a: DataFrame, b: DataFrame, spec: PanelSpec = P) -> DataFrame:
    """Rows of a matched in b by (entity, step), how many labels differ, and how many rows are lost."""
    keys = [spec.entity, spec.step]
    both = a.select(*keys, F.col(spec.rul).alias("_a")).join(b.select(*keys, F.col(spec.rul).alias("_b"), F.lit(True).alias("_in")), keys, "left")
    return both.agg(F.count_if(F.col("_in").isNotNull()).alias("matched"), F.count_if(F.col("_in").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"), F.count_if(F.col("_in").isNull()).alias("lost"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal-width bins 1..bins; the last takes its upper edge."""
    k = F.least(F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins))
    return df.where(F.col(column).between(low, high)).groupBy(k.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
