"""Ranks and exact quantiles within groups, of which one may hold most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.sources.scratch import materialise


def running_totals(df: DataFrame, by: list[str], order: list[str], weight: Column) -> DataFrame:
    """df with upto, the sum of weight over a group's rows up to this one, and total, that over the whole group.

    Rows are dealt by ranges of (by, order), so one group spans many tasks; each adds up its own run, and the runs' sums
    (a row for each group and partition) give what comes before it. Rows equal in by and order share a task: aggregate
    them first where there can be many. Nulls in by are a group. The dealt rows are written to the shared folder.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.withColumn("_w", weight).repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    runs = dealt.groupBy(*by, "_part").agg(F.sum("_w").alias("_s"))
    group = Window.partitionBy(*by)
    before = F.sum("_s").over(group.orderBy("_part")) - F.col("_s")
    runs = runs.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_part").alias("_run"), before.alias("_before"), F.sum("_s").over(group).alias("total"))
    same = dealt["_part"] == runs["_run"]
    for k, c in enumerate(by):
        same = same & dealt[c].eqNullSafe(runs[f"_by{k}"])
    local = F.sum("_w").over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("_local", local).join(runs, same)
    return out.select(*df.columns, (F.col("_before") + F.col("_local")).alias("upto"), "total")


def value_ranks(df: DataFrame, by: list[str], value: str | Column) -> DataFrame:
    """(by, value, n, upto, total): each distinct value that is not null, how many rows have it, and how many have it or less."""
    value = F.col(value) if isinstance(value, str) else value
    counts = df.select(*by, value.cast("double").alias("value")).where(F.col("value").isNotNull()).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, by, ["value"], F.col("n"))


def at_position(pos: Column) -> Column:
    """What a row of value_ranks adds to the value at a position from 0 of its group's sorted values, between neighbours by
    linear interpolation: null but for the one or two rows that have the position."""
    has = lambda k: (k >= F.col("upto") - F.col("n")) & (k < F.col("upto"))
    low, part = F.floor(pos), pos - F.floor(pos)
    share = F.when(has(low), 1 - part).otherwise(0.0) + F.when(has(low + 1), part).otherwise(0.0)
    return F.when(share > 0, F.when(share < 1, F.col("value") * share).otherwise(F.col("value")))


def exact_quantiles(df: DataFrame, by: list[str], value: str | Column, qs, accuracy: int = 10_000, few: bool = False) -> DataFrame:
    """(by, k, q, value): the q-quantiles of each group, as `percentile` gives them. Nulls don't count; groups without values
    give no rows.

    Nothing is run or written here. A sketch of each group gives a bracket of values around every quantile, about
    4 / accuracy of the group's rows wide. Then one aggregate counts the distinct values inside brackets, and as wholes
    the stretches between them with their least and largest value; sums of these counts in order give exact places. So a
    task ranks the brackets of a group only. A place that its bracket missed raises an error instead of a wrong value.
    few: the groups are few, so that their brackets are broadcast and no row is shuffled or sorted by its group.
    """
    qs = [float(q) for q in qs]
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*by, v.alias("value")).where(F.col("value").isNotNull())
    ends = [x for q in qs for x in (max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy))]
    sketch = rows.groupBy(*by).agg(F.percentile_approx("value", F.array(*map(F.lit, ends)), F.lit(accuracy)).alias("_e"))
    sketch = sketch.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.array(*[F.struct(F.col("_e")[2 * k].alias("lo"), F.col("_e")[2 * k + 1].alias("hi")) for k in range(len(qs))]).alias("_brackets"))
    if by:
        same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(sketch[f"_by{k}"]) for k, c in enumerate(by)])
        met = rows.join(F.broadcast(sketch) if few else sketch, same)
    else:
        met = rows.crossJoin(F.broadcast(sketch))  # one row
    x = F.col("value")
    inside = F.exists("_brackets", lambda b: (x >= b["lo"]) & (x <= b["hi"]))
    met = met.withColumn("_inside", inside).withColumn("_stretch", F.when(~F.col("_inside"), F.size(F.filter("_brackets", lambda b: b["hi"] < x))))
    cells = met.groupBy(*by, "_stretch", F.when(F.col("_inside"), x).alias("_value")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    group = Window.partitionBy(*by)
    placed = cells.withColumns({"upto": F.sum("n").over(group.orderBy("least")), "total": F.sum("n").over(group)})
    placed = placed.select("*", F.posexplode(F.array(*map(F.lit, qs))).alias("k", "q"))
    pos = F.col("q") * (F.col("total") - 1)
    low, part = F.floor(pos), pos - F.floor(pos)
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1

    def at(place: Column) -> Column:
        missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
        exact = F.when(F.col("_stretch").isNull(), F.col("_value")).when(place == first, F.col("least")).when(place == last, F.col("most")).otherwise(missed)
        return F.when((place >= first) & (place <= last), exact)

    below, above = at(low), F.when(part > 0, at(low + 1))
    share = F.when(below.isNotNull() & (part == 0), below).when(below.isNotNull() & above.isNotNull(), below * (1 - part) + above * part).when(below.isNotNull(), below * (1 - part)).when(above.isNotNull(), above * part)
    found = placed.withColumn("_at", share).where(F.col("_at").isNotNull())
    return found.groupBy(*by, "k", "q").agg(F.sum("_at").alias("value"))
