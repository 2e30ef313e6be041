"""Long entities dealt by ranges of their steps, so that an entity of any length is many tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.spec import PanelSpec

#: Rows of an entity that stay in one task; longer ones are dealt by RANGES ranges of steps with about as many rows each.
MOST_ROWS = 200_000
RANGES = 64
RANGE, OWN = "_range", "_own"


@dataclass(frozen=True)
class RangedSpec(PanelSpec):
    """A panel whose windows end at the ends of ranges."""

    def ordered(self, rows: int | None = None, ahead: int = 0):
        w = Window.partitionBy(self.entity, RANGE).orderBy(self.step)
        return w if rows is None else w.rowsBetween(-(rows - 1), ahead)

    def whole(self):
        raise TypeError("a range is not a whole entity")


def ranged(spec: PanelSpec) -> RangedSpec:
    return RangedSpec(**{f.name: getattr(spec, f.name) for f in fields(spec)})


def known_long(df: DataFrame, spec: PanelSpec, most: int | None = MOST_ROWS) -> int | None:
    """`most`, or None if no entity of df has more rows: then nothing has to be dealt, and plans are those of one window.

    The only thing here that runs at once: a count of rows by entity, which reads no other column. Callers who know that
    no entity is long pass None themselves, here and to all functions below.
    """
    if most is None:
        return None
    counts = df.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("_n"))
    return None if counts.where(F.col("_n") > most).isEmpty() else most


def range_cuts(df: DataFrame, spec: PanelSpec, most: int = MOST_ROWS) -> DataFrame:
    """(entity, _cuts): for entities of more than `most` rows, steps that cut theirs into RANGES parts of about equally many.

    Counts and quantile sketches are aggregated before they are shuffled. Cuts are steps that occur, so no range but the
    last can be empty.
    """
    long = df.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(spec.entity)
    rows = df.select(spec.entity, spec.step).join(long, spec.entity, "left_semi")
    at = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    return rows.groupBy(spec.entity).agg(F.array_distinct(F.percentile_approx(spec.step, at, F.lit(20 * RANGES))).alias("_cuts"))


def _range_of(spec: PanelSpec) -> Column:
    return F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(spec.step))))


def in_range_order(df: DataFrame, spec: PanelSpec, most: int | None = MOST_ROWS) -> DataFrame:
    """df with _cuts and the range of each row: 0 in entities that are not long."""
    if most is None:
        return df.withColumns({"_cuts": F.lit(None).cast("array<int>"), RANGE: F.lit(0)})
    return df.join(range_cuts(df, spec, most), spec.entity, "left").withColumn(RANGE, _range_of(spec))


def with_halo(df: DataFrame, before: int | Column, spec: PanelSpec, most: int | None = MOST_ROWS) -> DataFrame:
    """Rows of df with their range, and copies of the `before` rows ahead of each range in it. _own tells which are whose.
    `before` may be a column that is constant within an entity.

    Only rows of long entities are copied. For every range the step from which on earlier rows belong to it is found from
    the last rows of the ranges before (several, where ranges are shorter than `before`): a few numbers for each long
    entity, with which its rows then tell where they go.
    """
    if most is None:
        return df.withColumns({RANGE: F.lit(0), OWN: F.lit(True)})
    cuts = range_cuts(df, spec, most)
    wanted = df.select(spec.entity, spec.step, (F.lit(before) if isinstance(before, int) else before).alias("_before"))
    long = wanted.join(cuts, spec.entity).withColumn(RANGE, _range_of(spec))
    sizes = long.groupBy(spec.entity, RANGE).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(spec.entity).orderBy(RANGE))
    upto = sizes.withColumn("_u", upto).groupBy(spec.entity).agg(F.transform(F.sort_array(F.collect_list(F.struct(RANGE, "_u"))), lambda x: x["_u"]).alias("_upto"))  # RANGES numbers
    tail = long.withColumn("_end", F.row_number().over(Window.partitionBy(spec.entity, RANGE).orderBy(F.desc(spec.step)))).where(F.col("_end") <= F.col("_before"))
    r, n = F.col(RANGE), F.size("_upto")
    later = F.when(r + 1 < n, F.sequence(r + 1, n - 1)).otherwise(F.array().cast("array<int>"))
    needed = F.filter(later, lambda t: F.col("_end") + F.get("_upto", t - 1) - F.get("_upto", r) <= F.col("_before"))
    firsts = tail.join(upto, spec.entity).select(spec.entity, spec.step, F.explode(needed).alias("_t")).groupBy(spec.entity, "_t").agg(F.min(spec.step).alias("_from"))
    firsts = firsts.groupBy(spec.entity).agg(F.collect_list(F.struct("_t", "_from")).alias("_firsts"))
    rows = df.join(cuts.join(firsts, spec.entity, "left"), spec.entity, "left").withColumn("_at", _range_of(spec))
    ahead = F.filter("_firsts", lambda x: (x["_t"] > F.col("_at")) & (x["_from"] <= F.col(spec.step)))
    places = F.concat(F.array("_at"), F.coalesce(F.transform(ahead, lambda x: x["_t"]), F.array().cast("array<int>")))
    return rows.select(*df.columns, "_at", F.explode(places).alias(RANGE)).select(*df.columns, RANGE, (F.col(RANGE) == F.col("_at")).alias(OWN))


def over_ranges(df: DataFrame, before: int, spec: PanelSpec, make: Callable[[DataFrame, PanelSpec], DataFrame], most: int | None = MOST_ROWS) -> DataFrame:
    """make(rows, spec) with frames of at most `before` rows back, over rows dealt by ranges if there are long entities;
    each row of df once."""
    most = known_long(df, spec, most)
    if most is None:
        return make(df, spec)
    return make(with_halo(df, before, spec, most), ranged(spec)).where(F.col(OWN)).drop(RANGE, OWN)


def tail_rows(df: DataFrame, rows: int, spec: PanelSpec, most: int | None = MOST_ROWS) -> DataFrame:
    """The last `rows` rows of each entity, with their place from the end (_k, from 1 on) and the entity's number of rows
    (_n). If there are long entities, the last rows of each range are kept first."""
    most = known_long(df, spec, most)
    if most is None:
        last = Window.partitionBy(spec.entity)
        ranked = df.withColumns({"_k": F.row_number().over(last.orderBy(F.desc(spec.step))), "_n": F.count(F.lit(1)).over(last)})
        return ranked.where(F.col("_k") <= rows)
    counts = df.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("_n"))
    back = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(spec.step)))
    near = in_range_order(df, spec, most).withColumn("_k", back(spec.entity, RANGE)).where(F.col("_k") <= rows)
    last = near.select(*df.columns).withColumn("_k", back(spec.entity)).where(F.col("_k") <= rows)
    return last.join(counts, spec.entity).select(*df.columns, "_k", "_n")


Columns = dict[str, np.ndarray]


def map_run_lists(rows: DataFrame, keys: list[str], order: str, function: Callable[[list[Columns]], pa.RecordBatch | None], schema: str) -> DataFrame:
    """function over lists of runs, a run being the rows of one value of `keys` in order, as NumPy columns. A list has the
    runs that end in one Arrow batch, so many short ones; a run is as long as the ranges make it."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, *keys).sortWithinPartitions(*keys, order)

    def closed(held: list[pa.RecordBatch]) -> Columns:
        table = pa.Table.from_batches(held)
        return {c: table.column(c).to_numpy() for c in table.column_names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        of = lambda b, k: tuple(b.column(c)[k].as_py() for c in keys)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows - 1, bool)
            for c in keys:
                x = batch.column(c).to_numpy(zero_copy_only=False)
                new |= x[1:] != x[:-1]
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            ended = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and of(held[-1], 0) != of(batch, a):
                    ended.append(closed(held))
                    held = []
                held.append(batch.slice(a, b - a))
            if ended and (out := function(ended)) is not None:
                yield out
        if held and (out := function([closed(held)])) is not None:
            yield out

    return dealt.mapInArrow(run, schema)


def map_runs(rows: DataFrame, keys: list[str], order: str, function: Callable[[Columns], pa.RecordBatch | None], schema: str) -> DataFrame:
    """map_run_lists with a function of one run."""

    def each(runs: list[Columns]) -> pa.RecordBatch | None:
        out = [x for x in map(function, runs) if x is not None]
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    return map_run_lists(rows, keys, order, each, schema)
