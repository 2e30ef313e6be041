"""Scores of predictions, baselines, rankings and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalars import penalty
from panelspark.spec import RUL_CAP


def evaluate(predictions: DataFrame, *by: str, true: str = "true_rul", predicted: str = "rul_pred") -> DataFrame:
    """N, RMSE, asymmetric score and its mean, R2 and bias, in one aggregate. R2 is null where the truth is constant."""
    t, p = F.col(true), F.col(predicted)
    out = predictions.groupBy(*(by or ("model_name",))).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg((t - p) ** 2)).alias("rmse"),
        F.sum(penalty(t, p)).alias("score"),
        (1 - F.sum((t - p) ** 2) / F.nullif(F.var_pop(t) * F.count(t), F.lit(0.0))).alias("r2"),
        F.avg(p - t).alias("bias"),
    )
    return out.withColumn("score_mean", F.col("score") / F.col("n"))


def naive_baselines(test: DataFrame, train_mean: float | DataFrame, cap: int = RUL_CAP, true: str = "true_rul") -> DataFrame:
    """Predictions of a constant, the mean of train labels and half the cap. train_mean: a number, or a table with its only row's column `m`."""
    row = train_mean if isinstance(train_mean, DataFrame) else test.sparkSession.createDataFrame([(float(train_mean),)], "m double")
    both = test.select("entity_id", true).crossJoin(F.broadcast(row))  # one row
    guesses = F.array(F.struct(F.lit("train_mean").alias("model_name"), F.col("m").alias("rul_pred")), F.struct(F.lit("half_cap").alias("model_name"), F.lit(cap / 2).alias("rul_pred")))
    return both.select("entity_id", F.col(true).alias("true_rul"), F.inline(guesses))


def rank_models(metrics: DataFrame, by: str = "rmse") -> DataFrame:
    """1-based rank, of equals by name. There is one row for each model."""
    return metrics.withColumn("rank", F.row_number().over(Window.orderBy(by, "model_name")))


def best_of_grid(grid: DataFrame, by: str, order: str) -> DataFrame:
    """the grid's row with the least value, of equals the first in grid order."""
    return grid.agg(F.min_by(F.struct(*grid.columns), F.struct(by, order)).alias("r")).select("r.*")


def family_summary(metrics: DataFrame, family: str = "family") -> DataFrame:
    """The best model of each family, and the family's mean coverage and width."""
    best = F.min_by(F.struct("model_name", "rmse"), F.struct("rmse", "model_name"))
    out = metrics.groupBy(family).agg(best.alias("b"), F.avg("coverage").alias("coverage"), F.avg("width").alias("width"))
    return out.select(family, F.col("b.model_name").alias("best_model"), F.col("b.rmse").alias("rmse"), "coverage", "width")


def improvement(best: float, other: float) -> float:
    """Percent by which `best` is below `other`."""
    return 100.0 * (other - best) / other


def modal_value(df: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """The most frequent value; of equals the least, or with `order` the one seen first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(order or column).alias("first"))
    return counts.agg(F.max_by(F.struct(column, "n"), F.struct(F.col("n"), -F.col("first") if order else -F.col(column))).alias("r")).select("r.*")


def cap_grid(predictions: DataFrame, caps=(100, 110, 115, 120, 125, 130, 140, 150)) -> DataFrame:
    """Metrics of predictions and truth under each cap, in one pass over predictions and caps."""
    both = predictions.withColumn("cap", F.explode(F.array(*[F.lit(c) for c in caps])))
    capped = both.withColumns({c: F.least(F.col(c), F.col("cap").cast("double")) for c in ("true_rul", "rul_pred")})
    return evaluate(capped, "cap")


def top_sensors(profile: DataFrame, k: int = 5) -> DataFrame:
    """the k sensors of largest |r|."""
    return profile.orderBy(F.desc_nulls_last(F.abs("r")), "sensor").limit(k)
