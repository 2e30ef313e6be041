"""Prediction intervals: repair, coverage, quantile losses and split-conformal calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalars import clip
from panelspark.operators.ranks import at_position, value_ranks
from panelspark.spec import RUL_CAP


def repair_bounds(df: DataFrame, cap: int = RUL_CAP) -> DataFrame:
    """Bounds clipped, swapped if inverted, and widened to hold the prediction."""
    cut = {c: clip(F.col(c), 0.0, float(cap)) for c in ("rul_pred", "lower_bound", "upper_bound")}
    lo, hi = F.least("lower_bound", "upper_bound"), F.greatest("lower_bound", "upper_bound")
    return df.withColumns(cut).withColumns({"lower_bound": F.least(lo, "rul_pred"), "upper_bound": F.greatest(hi, "rul_pred")})


def validate_predictions(df: DataFrame, cap: int = RUL_CAP) -> DataFrame:
    """Counts of impossible values for each model; NaN and infinite values count once, as not finite."""
    value = lambda c: F.col(c).cast("double")
    finite = F.lit(True)
    for c in ("rul_pred", "lower_bound", "upper_bound"):
        finite = finite & value(c).isNotNull() & ~F.isnan(value(c)) & (F.abs(value(c)) != float("inf"))
    p, lo, hi = value("rul_pred"), value("lower_bound"), value("upper_bound")
    return df.groupBy("model_name").agg(
        F.count_if(finite & (p < 0)).alias("negative"),
        F.count_if(finite & (p > cap)).alias("over_cap"),
        F.count_if(finite & (lo > hi)).alias("inverted"),
        F.count_if(finite & ((p < lo - 1e-6) | (p > hi + 1e-6))).alias("outside"),
        F.count_if(~finite).alias("not_finite"),
    )


def _inside():
    return F.col("true_rul").between(F.col("lower_bound"), F.col("upper_bound"))


def coverage_width(df: DataFrame) -> DataFrame:
    """Percent of truths inside, and the mean width."""
    return df.groupBy("model_name").agg((F.avg(_inside().cast("double")) * 100).alias("coverage"), F.avg(F.col("upper_bound") - F.col("lower_bound")).alias("width"))


def quantile_rows(df: DataFrame, quantiles=((0.1, "lower_bound"), (0.5, "rul_pred"), (0.9, "upper_bound"))) -> DataFrame:
    """(model_name, true_rul, q, pred), a row for each quantile."""
    return df.select("model_name", "true_rul", F.inline(F.array(*[F.struct(F.lit(q).alias("q"), F.col(c).cast("double").alias("pred")) for q, c in quantiles])))


def pinball_by_quantile(long: DataFrame) -> DataFrame:
    """D24."""
    e = F.col("true_rul") - F.col("pred")
    return long.groupBy("model_name", "q").agg(F.avg(F.greatest(F.col("q") * e, (F.col("q") - 1) * e)).alias("pinball"))


def reliability_table(long: DataFrame) -> DataFrame:
    """Observed share of truths at or under each predicted quantile, and the model's mean distance from it."""
    per = long.groupBy("model_name", "q").agg(F.avg((F.col("true_rul") <= F.col("pred")).cast("double")).alias("observed"))
    return per.withColumn("mce", F.avg(F.abs(F.col("observed") - F.col("q"))).over(Window.partitionBy("model_name")))  # a row for each quantile


def coverage_by_bucket(df: DataFrame, edges=(0, 25, 50, 100, 125), close_last: bool = True) -> DataFrame:
    """N, coverage, mean and median width in half-open buckets of the truth; close_last: the last takes its upper edge."""
    bucket = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(edges[:-1], edges[1:], strict=True))):
        top = F.col("true_rul") <= hi if close_last and hi == edges[-1] else F.col("true_rul") < hi
        bucket = F.when((F.col("true_rul") >= lo) & top, F.lit(f"{lo}-{hi}")).otherwise(bucket)
    width = F.col("upper_bound") - F.col("lower_bound")
    rows = df.withColumn("bucket", bucket).where(F.col("bucket").isNotNull())
    return rows.groupBy("model_name", "bucket").agg(F.count(F.lit(1)).alias("n"), (F.avg(_inside().cast("double")) * 100).alias("coverage"), F.avg(width).alias("mean_width"), F.percentile(width, F.lit(0.5)).alias("median_width"))


def conformal_margin(df: DataFrame, targets=(0.8,), interpolate: bool = True) -> DataFrame:
    """(model_name, target, delta): the calibration quantile of max(lo - t, t - hi, 0) at level min(ceil((n + 1) target) / n, 1).

    The order statistics come from ranks of distinct scores, dealt over tasks (most scores are 0); `interpolate` False takes the upper one.
    """
    score = F.greatest(F.col("lower_bound") - F.col("true_rul"), F.col("true_rul") - F.col("upper_bound"), F.lit(0.0))
    ranks = value_ranks(df, ["model_name"], score).withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    n = F.col("total")
    pos = F.least(F.ceil((n + 1) * F.col("target")) / n, F.lit(1.0)) * (n - 1)
    at = ranks.withColumn("at", at_position(pos if interpolate else F.ceil(pos))).where(F.col("at").isNotNull())
    return at.groupBy("model_name", "target").agg(F.sum("at").alias("delta"))


def apply_margin(df: DataFrame, margins: DataFrame, cap: int = RUL_CAP) -> DataFrame:
    """Bounds widened by their model's delta and clipped; margins has a row for each model and target."""
    joined = df.join(margins, "model_name")
    return joined.withColumns({"lower_bound": clip(F.col("lower_bound") - F.col("delta"), 0.0, float(cap)), "upper_bound": clip(F.col("upper_bound") + F.col("delta"), 0.0, float(cap))})


def calibration_report(calibration: DataFrame, evaluation: DataFrame, targets=(0.8, 0.9), cap: int = RUL_CAP, passes: float = 79.5) -> DataFrame:
    """Coverage before and after, width after, delta and status of each model and target. Margins are fitted on
    rows that are not evaluated; truth is needed on both sides."""
    for side in (calibration, evaluation):
        if "true_rul" not in side.columns:
            raise ValueError("truth is needed")
    margins = conformal_margin(calibration, targets)
    after = apply_margin(evaluation, margins, cap).groupBy("model_name", "target", "delta").agg((F.avg(_inside().cast("double")) * 100).alias("after"), F.avg(F.col("upper_bound") - F.col("lower_bound")).alias("width"))
    before = coverage_width(evaluation).select("model_name", F.col("coverage").alias("before"))
    return after.join(before, "model_name").withColumn("status", F.when(F.col("after") >= passes, "ok").otherwise("low"))
