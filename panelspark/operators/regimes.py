"""Operating regimes and scaling within them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalars import half_even, regime_key
from panelspark.spec import PanelSpec

P = PanelSpec()


def regimes_by_rounding(df: DataFrame, settings=("op1", "op2"), name: str = "op_cluster") -> DataFrame:
    """H3: a number for each combination of rounded settings. The ranking is over the distinct combinations."""
    keyed = df.withColumn("_key", regime_key(*[F.col(c) for c in settings]))
    numbers = keyed.select("_key").distinct().withColumn(name, F.row_number().over(Window.orderBy("_key")))
    return keyed.join(numbers, "_key").drop("_key")


def weighted_settings(df: DataFrame, settings=("op1", "op2")) -> DataFrame:
    """Each distinct combination of settings as a vector `_settings`, with its number of rows `_n`: all that k-means needs
    to know of the rows, found in one scan."""
    from pyspark.ml.feature import VectorAssembler

    counts = df.groupBy(*settings).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    return VectorAssembler(inputCols=list(settings), outputCol="_settings").transform(counts)


def fit_regimes(train: DataFrame, k: int = 6, settings=("op1", "op2"), restarts: int = 10, seed: int = 42):
    """H1: k-means on the settings, the best of several seeds; k is at most the number of distinct rounded settings.

    Rows are scanned once: restarts are fitted on the distinct settings, weighted by their numbers of rows, which has the
    same cost as a fit on all rows.
    """
    from pyspark.ml.clustering import KMeans

    points = weighted_settings(train, settings).persist()
    try:
        k = min(k, points.select(*[half_even(F.col(c), 2).alias(c) for c in settings]).distinct().count())
        models = [KMeans(k=max(k, 2), seed=seed + r, featuresCol="_settings", weightCol="_n").fit(points) for r in range(restarts)]
    finally:
        points.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost)


def save_regimes(model, path: str) -> None:
    """A4: the fitted model of fit_regimes, in place of what the path holds."""
    model.write().overwrite().save(path)


def load_regimes(path: str):
    from pyspark.ml.clustering import KMeansModel

    return KMeansModel.load(path)


def assign_regimes(df: DataFrame, centres: list[list[float]], settings=("op1", "op2"), name: str = "op_cluster") -> DataFrame:
    """H2: the nearest of fixed centres, of equally near ones the first."""
    distance = [sum(((F.col(c) - F.lit(float(x))) ** 2 for c, x in zip(settings, centre, strict=True)), F.lit(0.0)) for centre in centres]
    return df.withColumn("_d", F.array(*distance)).withColumn(name, (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d")


def choose_k(df: DataFrame, ks=range(1, 11), settings=("op1", "op2"), sample: int = 5000, seed: int = 42) -> DataFrame:
    """H4: inertia over all rows, from distinct settings weighted by their numbers of rows; Euclidean silhouette and
    Davies-Bouldin index over the `sample` rows of least hash.

    The sample is bounded, so its pairwise distances are too; they are computed as a join of the sample with itself in blocks.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    spark = df.sparkSession
    vectors = VectorAssembler(inputCols=list(settings), outputCol="_settings").transform(df).withColumn("_h", F.xxhash64(*df.columns))
    few = vectors.orderBy("_h").limit(sample).select(F.monotonically_increasing_id().alias("i"), "_settings", *settings)
    few = few.repartition(spark.sparkContext.defaultParallelism, "i").persist()  # so that the pairs are made in many tasks
    points = weighted_settings(df, settings).persist()
    rows = []
    try:
        for k in ks:
            if k == 1:
                n = vectors.agg(*[F.var_pop(c).alias(c) for c in settings], F.count(F.lit(1)).alias("n")).first()
                rows.append((k, float(sum(n[c] for c in settings) * n["n"]), None, None))
                continue
            model = KMeans(k=k, seed=seed, featuresCol="_settings", weightCol="_n").fit(points)
            at = model.transform(few).select("i", *settings, F.col("prediction").alias("c"))
            other = at.select(F.col("i").alias("j"), *[F.col(s).alias(f"{s}_") for s in settings], F.col("c").alias("c_"))
            d = F.sqrt(sum(((F.col(s) - F.col(f"{s}_")) ** 2 for s in settings), F.lit(0.0)))
            near = at.join(F.broadcast(other), F.col("i") != F.col("j")).groupBy("i", "c", "c_").agg(F.avg(d).alias("d"))
            a, b = F.max(F.when(F.col("c") == F.col("c_"), F.col("d"))), F.min(F.when(F.col("c") != F.col("c_"), F.col("d")))
            s = near.groupBy("i").agg(a.alias("a"), b.alias("b")).agg(F.avg(F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0)))).first()[0]
            spread = at.groupBy("c").agg(*[F.avg(x).alias(x) for x in settings])
            away = at.join(F.broadcast(spread.select(F.col("c"), *[F.col(x).alias(f"{x}_") for x in settings])), "c").groupBy("c").agg(F.avg(d).alias("spread"))
            full = spread.join(away, "c")
            pair = full.crossJoin(F.broadcast(full.select(F.col("c").alias("c_"), F.col("spread").alias("spread_"), *[F.col(x).alias(f"{x}_") for x in settings]))).where("c <> c_")
            db = pair.groupBy("c").agg(F.max((F.col("spread") + F.col("spread_")) / F.nullif(d, F.lit(0.0))).alias("r")).agg(F.avg("r")).first()[0]
            rows.append((k, float(model.summary.trainingCost), s, db))
    finally:
        few.unpersist()
        points.unpersist()
    out = spark.createDataFrame(rows, "k int, inertia double, silhouette double, davies_bouldin double")
    w = Window.orderBy("k")  # one row for each k
    bend = F.lag("inertia").over(w) - 2 * F.col("inertia") + F.lead("inertia").over(w)
    out = out.withColumn("_bend", bend)
    everywhere = Window.partitionBy()
    return out.select("k", "inertia", "silhouette", "davies_bouldin", (F.col("silhouette") == F.max("silhouette").over(everywhere)).alias("best_silhouette"), (F.col("_bend") == F.max("_bend").over(everywhere)).alias("elbow"))


def regime_crosstab(df: DataFrame, regime: str, cluster: str) -> DataFrame:
    """Counts of (regime, cluster), the long form."""
    return df.groupBy(regime, cluster).agg(F.count(F.lit(1)).alias("n"))


def regime_dominance(cells: DataFrame, regime: str) -> DataFrame:
    """The mean over regimes of the largest cluster's share, and whether it passes."""
    per = cells.groupBy(regime).agg((F.max("n") / F.sum("n")).alias("share"))
    return per.agg(F.avg("share").alias("dominance")).withColumn("passes", F.col("dominance") >= 0.95)


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    """D8."""
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand_index(cells: DataFrame, regime: str, cluster: str) -> DataFrame:
    """Chance-corrected agreement of two labellings, from their crosstab."""
    pairs = lambda c: (F.col(c) * (F.col(c) - 1) / 2).cast("double")
    s = lambda by, name: cells.groupBy(*by).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias(name))
    row = s((regime, cluster), "ij").crossJoin(s((regime,), "i")).crossJoin(s((cluster,), "j")).crossJoin(s((), "t"))
    expected = F.col("i") * F.col("j") / F.nullif(F.col("t"), F.lit(0.0))
    return row.select(((F.col("ij") - expected) / F.nullif((F.col("i") + F.col("j")) / 2 - expected, F.lit(0.0))).alias("ari"))


def cluster_labels_join(raw: DataFrame, labelled: DataFrame, cluster: str, spec: PanelSpec = P) -> DataFrame:
    """Labels onto raw rows by (entity, step)."""
    keys = [spec.entity, spec.step]
    return raw.join(labelled.select(*keys, cluster).dropDuplicates(keys), keys)


def regime_parameters(train: DataFrame, sensors, regime: str = "regime") -> DataFrame:
    """(regime, sensor_mean, sensor_std): population deviations, 1 where zero; a regime of one row takes those of all rows."""
    stats = lambda suffix: [f(s).alias(f"{s}_{n}{suffix}") for s in sensors for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    per = train.groupBy(regime).agg(F.count(F.lit(1)).alias("_n"), *stats(""))
    both = per.crossJoin(F.broadcast(train.agg(*stats("_all"))))  # one row
    value = lambda c: F.when(F.col("_n") < 2, F.col(f"{c}_all")).otherwise(F.col(c))
    unit = lambda c: F.when(c == 0, F.lit(1.0)).otherwise(c)
    return both.select(regime, *[(unit(value(f"{s}_std")) if n == "std" else value(f"{s}_mean")).alias(f"{s}_{n}") for s in sensors for n in ("mean", "std")])


def small(parameters: DataFrame, most: int = 20_000) -> DataFrame:
    """Parameters of at most `most` regimes are computed once, here, and go to every task as a local table, whatever sizes
    Spark knows; a larger table is joined as any other."""
    rows = parameters.limit(most + 1).collect()
    return F.broadcast(parameters.sparkSession.createDataFrame(rows, parameters.schema)) if len(rows) <= most else parameters


def unseen_regimes(df: DataFrame, parameters: DataFrame, regime: str = "regime") -> DataFrame:
    """Regimes without parameters; must be empty."""
    return df.select(regime).distinct().join(parameters, regime, "left_anti")


def apply_regime_scaler(df: DataFrame, parameters: DataFrame, sensors, regime: str = "regime", check: bool = True) -> DataFrame:
    """(x - mean) / std by regime. The panel is not shuffled by its few regimes (see small)."""
    if check and not unseen_regimes(df, parameters, regime).isEmpty():
        raise KeyError("a regime has no scaler")
    joined = df.join(small(parameters), regime)
    return joined.select(*[((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(c) if c in sensors else F.col(c) for c in df.columns])
