"""Raw text panels and truth files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators.ranks import running_totals
from panelspark.spec import RAW_SCHEMA


def read_panel_text(spark: SparkSession, path: str, schema=RAW_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """A1: rows of a header-less, white-space separated file, and the lines that don't fit the schema."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "")
    cells = [F.get(parts, k).try_cast(f.dataType).alias(f.name) for k, f in enumerate(schema.fields)]
    parsed = lines.select("value", F.size(parts).alias("_n"), *cells)
    whole = F.col("_n") == len(schema.fields)
    for f in schema.fields:
        whole = whole & F.col(f.name).isNotNull()
    return parsed.where(whole).drop("value", "_n"), parsed.where(~whole).select("value")


def read_truth_text(spark: SparkSession, path: str) -> DataFrame:
    """A2: (ordinal, rul_last); line i, blank lines aside, belongs to the i-th smallest entity.

    A file is read in its splits, and a folder's files in the order of their names: lines are numbered within their split,
    and the splits' counts (a row for each) give what comes before. So a file of any size is many tasks.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split")]
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\r", "")).alias("line"), *place, F.monotonically_increasing_id().alias("_row")).where(F.col("line") != "")
    counts = lines.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_split")) - F.col("_n")  # one row for each split
    offsets = counts.select(F.col("_file").alias("_f"), F.col("_split").alias("_s"), before.alias("_before"))
    numbered = lines.withColumn("_k", F.row_number().over(Window.partitionBy("_file", "_split").orderBy("_row")))
    met = numbered.join(offsets, (F.col("_file") == F.col("_f")) & (F.col("_split") == F.col("_s")))
    return met.select((F.col("_before") + F.col("_k")).alias("ordinal"), F.col("line").cast("int").alias("rul_last"))


def attach_truth(panel: DataFrame, truth: DataFrame, entity: str = "engine_id") -> DataFrame:
    """The panel with each entity's rul_last. Raises if the numbers of entities and lines differ. Entities are
    ranked over range partitions."""
    ids = running_totals(panel.select(entity).distinct(), [], [entity], F.lit(1)).select(entity, F.col("upto").alias("ordinal"))
    n, m = ids.count(), truth.count()
    if n != m:
        raise ValueError(f"{n} entities but {m} truth values")
    return panel.join(ids.join(truth, "ordinal").drop("ordinal"), entity)  # one row for each entity
