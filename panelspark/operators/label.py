"""Remaining-life labels, histories cut short, and splits by entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.ranks import running_totals
from panelspark.spec import PanelSpec

P = PanelSpec()


def label_rul_train(df: DataFrame, spec: PanelSpec = P) -> DataFrame:
    """min(last step - step, cap), without a join."""
    left = F.max(spec.step).over(spec.whole()) - F.col(spec.step)
    return df.withColumn(spec.rul, F.least(left, F.lit(spec.cap)).cast("int"))


def label_rul_test(df: DataFrame, spec: PanelSpec = P, truth: str = "rul_last") -> DataFrame:
    """The same for histories that end rul_last steps before the end; the truth column goes, lest it leak."""
    if truth not in df.columns:
        raise ValueError(f"{truth} is missing")
    left = F.col(truth) + F.max(spec.step).over(spec.whole()) - F.col(spec.step)
    return df.withColumn(spec.rul, F.least(left, F.lit(spec.cap)).cast("int")).drop(truth)


def label_violations(df: DataFrame, spec: PanelSpec = P, to_failure: bool = True) -> DataFrame:
    """Rows whose label is out of range, or isn't 0 at the last step of a run to failure."""
    last = F.col(spec.step) == F.max(spec.step).over(spec.whole())
    rows = df.withColumn("_last", last)
    bad = (F.col(spec.rul) < 0) | (F.col(spec.rul) > spec.cap) | F.col(spec.rul).isNull()
    if to_failure:
        bad = bad | (F.col("_last") & (F.col(spec.rul) != 0))
    return rows.where(bad).select(spec.entity, spec.step, spec.rul)


def last_rows(df: DataFrame, spec: PanelSpec = P) -> DataFrame:
    """The last row of each entity, by one aggregate."""
    return df.groupBy(spec.entity).agg(F.max_by(F.struct(*df.columns), spec.step).alias("_r")).select("_r.*")


def first_entities(df: DataFrame, n: int, spec: PanelSpec = P) -> DataFrame:
    """the rows of the n smallest entities."""
    few = df.select(spec.entity).distinct().orderBy(spec.entity).limit(n)
    return df.join(few, spec.entity, "left_semi")


def truncate_histories(df: DataFrame, low: float = 0.2, high: float = 0.9, seed: int = 42, spec: PanelSpec = P, least: int = 20) -> DataFrame:
    """Each entity's history up to a cut told by its number and the seed, with rul_last; short entities are left out."""
    n = F.max(spec.step).over(spec.whole())
    rows = df.withColumn("_n", n).where(F.col("_n") >= least)
    lo = F.greatest(F.lit(10), F.floor(F.col("_n") * low).cast("int"))
    hi = F.least(F.greatest(lo + 1, F.floor(F.col("_n") * high).cast("int") + 1), F.col("_n"))
    cut = (lo + F.pmod(F.col(spec.entity) * 7919 + seed, hi - lo)).cast("int")
    return rows.withColumn("_cut", cut).where(F.col(spec.step) <= F.col("_cut")).withColumn("rul_last", F.col("_n") - F.col("_cut")).drop("_n", "_cut")


def entity_split(df: DataFrame, share: float = 0.8, seed: int = 42, spec: PanelSpec = P) -> DataFrame:
    """(entity, part): whole entities in the order of an arithmetic hash, ranked over range partitions; the first `share`
    of them are train."""
    ids = df.select(spec.entity).distinct().withColumn("_h", F.pmod(F.col(spec.entity) * 7919 + seed, F.lit(10007)))
    ranked = running_totals(ids, [], ["_h", spec.entity], F.lit(1))
    return ranked.select(spec.entity, F.when(F.col("upto") <= F.floor(F.col("total") * share), "train").otherwise("valid").alias("part"))
