"""Tables between stages: panels, fitted parameters, predictions and the log of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators.metrics import evaluate
from panelspark.spec import PanelSpec


def write_stage(panel: DataFrame, path: str, spec: PanelSpec = PanelSpec()) -> None:
    """A3, F1: Parquet with each entity's rows together and in order; there is no global sort."""
    panel.repartition(spec.entity).sortWithinPartitions(spec.entity, spec.step).write.mode("overwrite").parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_parameters(tables: dict[str, DataFrame], path: str) -> None:
    """A4: fitted parameter tables (scalers, bounds, index weights) by name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_parameters(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def append_results(predictions: DataFrame, path: str, model_type: str, at: str) -> None:
    """A5: one row of metrics for each model, appended; interval columns are null where no bounds are."""
    m = evaluate(predictions)
    spans = predictions.groupBy("model_name").agg(
        F.bround(F.avg(F.col("upper_bound") - F.col("lower_bound")), 2).alias("interval_width"),
        F.bround(F.avg(F.col("true_rul").between(F.col("lower_bound"), F.col("upper_bound")).cast("double")) * 100, 2).alias("coverage_pct"),
    )
    row = m.join(spans, "model_name").select(
        "model_name",
        F.lit(model_type).alias("model_type"),
        F.bround("rmse", 4).alias("rmse"),
        F.bround("score", 2).alias("score"),
        F.bround("score_mean", 4).alias("score_mean"),
        F.bround("r2", 4).alias("r2"),
        F.bround("bias", 4).alias("bias"),
        "interval_width",
        "coverage_pct",
        F.col("n").alias("n_entities"),
        F.to_timestamp(F.lit(at)).alias("timestamp"),
    )
    row.write.mode("append").parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Checked and rounded predictions with in_interval, a folder for each model. Bounds are checked in the pass that
    writes: rows out of order end it with ValueError, and what the path had before stays."""
    crossed = F.col("lower_bound") > F.col("upper_bound") + 1e-6
    lower = F.when(crossed, F.raise_error(F.lit(_CROSSED)).cast("double")).otherwise(F.col("lower_bound"))
    inside = F.col("true_rul").between(F.col("lower_bound"), F.col("upper_bound")).cast("int")
    checked = {"lower_bound": lower}
    rounded = [F.bround(checked.get(c, F.col(c)), 2).alias(c) for c in ("true_rul", "rul_pred", "lower_bound", "upper_bound")]
    out = predictions.select("entity_id", "model_name", *rounded, F.bround(F.col("upper_bound") - F.col("lower_bound"), 2).alias("confidence_width"), inside.alias("in_interval"))
    try:
        out.repartition("model_name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_name").parquet(path)
    except Exception as e:
        if _CROSSED in str(e):
            raise ValueError(_CROSSED) from e
        raise


_CROSSED = "lower bounds above upper bounds"


def load_predictions(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Raises if the model has none."""
    out = spark.read.parquet(path).where(F.col("model_name") == model)
    if out.isEmpty():
        raise FileNotFoundError(f"no predictions of {model}")
    return out


def latest_results(log: DataFrame, by_column: bool = True) -> DataFrame:
    """The latest row of each model, ranked by RMSE. by_column: a null takes the last value that isn't null."""
    order = Window.partitionBy("model_name").orderBy("timestamp")
    values = [c for c in log.columns if c not in ("model_name", "timestamp")]
    if by_column:
        full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        log = log.select("model_name", "timestamp", *[F.last(c, ignorenulls=True).over(full).alias(c) for c in values])
        order = Window.partitionBy("model_name").orderBy(F.desc("timestamp"))
        last = log.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    else:
        last = log.groupBy("model_name").agg(F.max_by(F.struct("timestamp", *values), "timestamp").alias("r")).select("model_name", "r.*")
    return last.withColumn("rank", F.row_number().over(Window.orderBy("rmse", "model_name")))


def load_for_calibration(predictions: DataFrame, models: list[str]) -> DataFrame:
    """Rows with truth and bounds, under short names; models without rows are skipped."""
    names = {"true_rul": "t", "lower_bound": "lo", "upper_bound": "hi", "model_name": "model"}
    return predictions.where(F.col("model_name").isin(models)).dropna(subset=["true_rul", "lower_bound", "upper_bound"]).withColumnsRenamed(names)


__all__ = ["append_results", "latest_results", "load_for_calibration", "load_parameters", "load_predictions", "read_stage", "save_parameters", "write_predictions", "write_stage"]
