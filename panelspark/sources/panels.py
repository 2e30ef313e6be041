"""Panels derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators.regimes import regime_parameters, small


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as entities, their line items in order as steps. The long order leaves no ties."""
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount")
    d = lambda c, n: F.col(c).cast("double").alias(n)
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity_id"), F.row_number().over(w).alias("step"), F.concat("l_returnflag", "l_linestatus").alias("regime"),
        d("l_discount", "op1"), d("l_tax", "op2"), d("l_quantity", "s1"), d("l_extendedprice", "s2"), d("l_discount", "s3"), d("l_tax", "s4"),
    )


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as entities, their events in time order as steps."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity_id"), F.row_number().over(w).alias("step"), F.col("event_type").alias("regime"), F.col("value").cast("double").alias("s1"),
        F.get_json_object("props", "$.k").cast("double").alias("s2"), F.coalesce((micros - F.lag(micros).over(w)) / 1e6, F.lit(0.0)).alias("s3"),
    )


def is_test() -> F.Column:
    return F.col("entity_id") % 5 == 0


def lifetime_predictions(panel: DataFrame) -> DataFrame:
    """Predictions for cut test histories from the quantiles of train lifetimes, without a learned model."""
    n = panel.groupBy("entity_id").agg(F.max("step").alias("n"))
    q = n.where(~is_test()).agg(*[F.percentile("n", F.lit(p)).alias(c) for p, c in ((0.1, "a"), (0.5, "m"), (0.9, "z"))])
    lo = F.greatest(F.lit(10), F.floor(F.col("n") * 0.75).cast("int"))
    hi = F.least(F.greatest(F.col("lo") + 1, F.floor(F.col("n") * 0.99).cast("int") + 1), F.col("n"))
    cut = n.where(is_test()).withColumn("lo", lo).withColumn("hi", hi).withColumn("cut", (F.col("lo") + (F.col("entity_id") * 7919 + 42) % (F.col("hi") - F.col("lo"))).cast("int"))
    left = lambda c: F.least(F.greatest(F.col(c) - F.col("cut"), F.lit(0)), F.lit(125)).cast("double")
    return cut.crossJoin(F.broadcast(q)).select(  # q has one row
        "entity_id", F.lit("lifetime_table").alias("model_name"), F.least(F.col("n") - F.col("cut"), F.lit(125)).cast("double").alias("true_rul"),
        left("m").alias("rul_pred"), left("a").alias("lower_bound"), left("z").alias("upper_bound"),
    )


def two_models(panel: DataFrame) -> DataFrame:
    """The lifetime table and a constant guess."""
    base = lifetime_predictions(panel)
    return base.unionByName(base.withColumns({"model_name": F.lit("half_cap"), "rul_pred": F.lit(62.5), "lower_bound": F.lit(0.0), "upper_bound": F.lit(125.0)}))


def fixed_health(panel: DataFrame) -> DataFrame:
    """A health index of fixed weights, by train means and population deviations of the regime, with a planted trend."""
    p = regime_parameters(panel.where(~is_test()), ["s1", "s2"])
    z = lambda s: (F.col(s) - F.col(f"{s}_mean")) / F.col(f"{s}_std")
    joined = panel.join(small(p), "regime")
    return joined.select(*panel.columns, (0.6 * z("s1") + 0.4 * z("s2") + 0.01 * F.col("step")).alias("hi"))


__all__ = ["events_panel", "fixed_health", "is_test", "lifetime_predictions", "lineitem_panel", "read", "two_models"]
