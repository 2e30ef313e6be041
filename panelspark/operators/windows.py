"""Ordered windows over entities: rolling features, differences, autocorrelation and model inputs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from panelspark.operators.ranges import MOST_ROWS, OWN, RANGE, known_long, over_ranges, tail_rows, with_halo
from panelspark.operators.ranks import running_totals
from panelspark.spec import PanelSpec

P = PanelSpec()
#: Places of a block whose rolling means one task takes.
SMOOTHED = 4096
#: Window arrays of one Arrow batch.
CUT = 4096


def rolling_features(df: DataFrame, windows=(5, 10, 20), spec: PanelSpec = P, most: int | None = MOST_ROWS) -> DataFrame:
    """Trailing mean and sample deviation (0 for one row); all frames share one exchange and one sort. Entities of more
    than `most` rows are dealt by ranges of steps."""

    def features(rows: DataFrame, spec: PanelSpec) -> DataFrame:
        out = {}
        for s in spec.sensors:
            for w in windows:
                frame = spec.ordered(w)
                out[f"{s}_rmean_{w}"] = F.avg(s).over(frame)
                out[f"{s}_rstd_{w}"] = F.coalesce(F.stddev_samp(s).over(frame), F.lit(0.0))
        return rows.withColumns(out)

    return over_ranges(df, max(windows) - 1, spec, features, most)


def rolling_violations(df: DataFrame, columns: list[str], spec: PanelSpec = P) -> DataFrame:
    """E5: rows with a null feature, or with a deviation at an entity's first step."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
        if "_rstd_" in c:
            bad = bad | ((F.col("_k") == 1) & (F.col(c) != 0))
    return df.withColumn("_k", F.row_number().over(spec.ordered())).where(bad).select(spec.entity, spec.step)


def rolling_median(df: DataFrame, column: str, window: int = 10, name: str | None = None, spec: PanelSpec = P, most: int | None = MOST_ROWS) -> DataFrame:
    """Trailing median; long entities by ranges of steps."""
    name = name or f"{column}_median"
    if window <= 1:
        return df.withColumn(name, F.col(column))
    return over_ranges(df, window - 1, spec, lambda rows, spec: rows.withColumn(name, F.percentile(column, F.lit(0.5)).over(spec.ordered(window))), most)


def recent_window(df: DataFrame, share: float = 0.3, least: int = 20, most: int = 60, spec: PanelSpec = P, task_rows: int | None = MOST_ROWS) -> DataFrame:
    """The last min(max(round(share * n), least), most) rows of each entity, rounding halves to even. task_rows: as `most`
    of the functions above."""
    rows = tail_rows(df, most, spec, task_rows)
    return rows.where(F.col("_k") <= F.greatest(F.bround(F.col("_n") * share), F.lit(least))).drop("_k", "_n")


def difference(df: DataFrame, column: str, d: int = 1, spec: PanelSpec = P, most: int | None = MOST_ROWS) -> DataFrame:
    """The d-th difference; an entity's first d rows go. Long entities by ranges of steps."""

    def differences(rows: DataFrame, spec: PanelSpec) -> DataFrame:
        w = spec.ordered()
        out = rows.withColumn("_k", F.row_number().over(w)).withColumn("diff", F.col(column))  # places count from the halo's first row
        for _ in range(d):
            out = out.withColumn("diff", F.col("diff") - F.lag("diff").over(w))
        return out.where(F.col("_k") > d).drop("_k")

    return over_ranges(df, d, spec, differences, most)


def undifference(diffs: DataFrame, seeds: DataFrame, d: int = 1, spec: PanelSpec = P) -> DataFrame:
    """Levels from d-th differences. seeds: (entity, level [, slope]), the last level before the rows and, for d = 2, the last first difference."""
    w = spec.ordered().rowsBetween(Window.unboundedPreceding, 0)
    out = diffs.join(seeds, spec.entity)
    if d == 2:
        out = out.withColumn("diff", F.col("slope") + F.sum("diff").over(w))
    return out.withColumn("value", F.col("level") + F.sum("diff").over(w)).drop("level", "slope")


def life_bins(df: DataFrame, bins: int = 20, spec: PanelSpec = P) -> DataFrame:
    """Mean sensors in equal bins of normalised life, right-closed; entities of one row count as their beginning."""
    lo, hi = F.min(spec.step).over(spec.whole()), F.max(spec.step).over(spec.whole())
    life = F.coalesce((F.col(spec.step) - lo) / F.nullif(hi - lo, F.lit(0)), F.lit(0.0))
    k = F.greatest(F.ceil(F.round(life * bins, 9)) - 1, F.lit(0)).cast("int")
    return df.withColumn("bin", k).groupBy("bin").agg(*[F.avg(s).alias(s) for s in spec.sensors], F.count(F.lit(1)).alias("n"))


def acf_table(df: DataFrame, column: str, lags: int = 20, spec: PanelSpec = P, most: int | None = MOST_ROWS) -> DataFrame:
    """Autocorrelation of each entity's series at lags 0 to `lags`, as sums of products of lagged values; long
    entities by ranges of steps, whose sums are added up."""
    most = known_long(df, spec, most)
    if most is None:
        x = df.select(spec.entity, spec.step, (F.col(column) - F.avg(column).over(spec.whole())).alias("x"))
    else:
        means = df.groupBy(spec.entity).agg(F.avg(column).alias("_mean"))
        x = df.join(means, spec.entity).select(spec.entity, spec.step, (F.col(column) - F.col("_mean")).alias("x"))

    def lagged(rows: DataFrame, spec: PanelSpec) -> DataFrame:
        w = spec.ordered()
        return rows.withColumns({f"p{k}": F.col("x") * F.lag("x", k).over(w) for k in range(lags + 1)})

    products = over_ranges(x, lags, spec, lagged, most)
    sums = products.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(lags + 1)])
    long = sums.select(spec.entity, "n", "p0", F.posexplode(F.array(*[F.col(f"p{k}") for k in range(lags + 1)])).alias("lag", "p"))
    return long.where(F.col("lag") < F.col("n")).select(spec.entity, "lag", "n", (F.col("p") / F.nullif(F.col("p0"), F.lit(0.0))).alias("acf"))


def durbin_levinson(acf: np.ndarray) -> np.ndarray:
    """Partial autocorrelations at lags 1.. from autocorrelations at lags 0.."""
    phi, out, v = np.zeros(0), [], 1.0
    for k in range(1, len(acf)):
        a = (acf[k] - phi @ acf[1:k][::-1]) / v if v > 1e-12 else 0.0
        phi = np.append(phi - a * phi[::-1], a)
        v *= 1 - a * a
        out.append(a)
    return np.array(out)


def pacf_table(acf: DataFrame, spec: PanelSpec = P) -> DataFrame:
    """From acf_table, a short recursion for each entity."""
    lists = acf.groupBy(spec.entity).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"]).alias("a"))

    @F.pandas_udf("array<double>")
    def partial(a: pd.Series) -> pd.Series:
        return a.map(lambda x: durbin_levinson(np.array(x, float)).tolist() if x is not None and all(v is not None for v in x) else [])

    return lists.select(spec.entity, F.posexplode(partial("a")).alias("k", "pacf")).select(spec.entity, (F.col("k") + 1).alias("lag"), "pacf")


def _windows(batches: Iterator[pa.RecordBatch], keys: list[str], out: list[str], width: int, values: list[str], last_only: bool) -> Iterator[pa.RecordBatch]:
    """Windows of rows that come ordered by run (keys) and step. Only the last `width` rows of a run are held between batches.

    With OWN among the columns a run may be a part of an entity, whose number of rows is in _n: windows end at own rows,
    and only entities of fewer rows than `width` are padded."""
    held, before = None, 0  # the last rows of the run that goes on, and how many of it came before them

    def cut(t: pa.RecordBatch, known: int, before: int, last: bool) -> tuple[list[pa.RecordBatch], int, int]:
        n = t.num_rows
        edge = np.arange(n) == 0
        for c in keys:
            code = t.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
            edge[1:] |= code[1:] != code[:-1]
        starts = np.flatnonzero(edge)
        first = np.repeat(starts, np.diff(np.append(starts, n)))
        place = np.arange(n) - first + np.where(first == 0, before, 0)
        end, full = np.append(edge[1:], last), place >= width - 1
        short = end & ~full
        if OWN in t.schema.names:
            short &= t.column("_n").to_numpy() < width
            full &= t.column(OWN).to_numpy(zero_copy_only=False).astype(bool)
        at = np.flatnonzero(short | (full & (end if last_only else np.arange(n) >= known)))
        x = np.column_stack([t.column(c).to_numpy(zero_copy_only=False) for c in values]).astype(float)
        empty = np.column_stack([t.column(c).is_null().to_numpy(zero_copy_only=False) for c in values])
        found = []
        for i in (at[k : k + CUT] for k in range(0, len(at), CUT)):
            rows = i[:, None] + np.arange(1 - width, 1)
            inside = rows >= first[i][:, None]
            rows = np.maximum(rows, 0)
            flat = np.where(inside[:, :, None], x[rows], 0.0).ravel()
            flat = pa.array(flat, mask=(inside[:, :, None] & empty[rows]).ravel()) if empty.any() else pa.array(flat)
            ends = pa.array(np.arange(len(i) + 1) * (width * len(values)), pa.int32())
            told = [t.column(c).take(pa.array(i)) for c in out] + [pa.ListArray.from_arrays(ends, flat)]
            if "label" in t.schema.names:
                told.append(t.column("label").take(pa.array(i if last_only else np.where(short[i], first[i], i))))
            found.append(pa.record_batch(told, names=[*out, "features", *["label"] * (len(told) > len(out) + 1)]))
        kept = max(starts[-1], n - width)
        return found, int(kept), int(place[kept])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        found, kept, before = cut(t, 0 if held is None else held.num_rows, before, False)
        held = pa.Table.from_batches([t.slice(kept)]).take(pa.array(np.arange(t.num_rows - kept))).combine_chunks().to_batches()[0]  # a copy: a slice would hold the batch
        yield from found
    if held is not None:
        yield from cut(held, held.num_rows, before, True)[0]


def window_arrays(df: DataFrame, features, width: int = 30, last_only: bool = False, spec: PanelSpec = P, most: int | None = MOST_ROWS) -> DataFrame:
    """(entity, step, features, label): the last `width` rows, flattened oldest first. Train takes every full window,
    last_only the last row's. Entities shorter than `width` give one window, padded with zeros on the left, whose label is that of the first row (last_only: of the last).

    Rows are shuffled and sorted once and cut as they come, so time goes with the values that windows have; long entities
    are dealt by ranges of steps."""
    label = spec.rul in df.columns
    values = [f"_f{k}" for k in range(len(features))]
    rows = df.select(spec.entity, spec.step, *[F.col(f).cast("double").alias(v) for f, v in zip(features, values, strict=True)], *[F.col(spec.rul).cast("double").alias("label")] * label)
    most, keys = known_long(df, spec, most), [spec.entity]
    if most is not None and last_only:
        rows = tail_rows(rows, width, spec, most).drop("_k", "_n")
    elif most is not None:
        counts = rows.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("_n"))
        rows, keys = with_halo(rows, width - 1, spec, max(most, width)).join(counts, spec.entity), [spec.entity, RANGE]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = [spec.entity, spec.step]
    schema = StructType([*[rows.schema[c] for c in out], StructField("features", ArrayType(DoubleType())), *[StructField("label", DoubleType())] * label])
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, spec.step).mapInArrow(lambda batches: _windows(batches, keys, out, width, values, last_only), schema)


def sorted_smoothing(predictions: DataFrame, width: int = 10) -> DataFrame:
    """Per model, predictions in the order of the truth with a centred rolling mean, for reports over test entities.

    Places come from range partitions. Means are taken in blocks of SMOOTHED places, which rows near an edge reach from
    the block beside it too, so that a model of very many entities is many tasks."""
    before, after = width // 2, width - width // 2 - 1
    rows = predictions.select("model_name", "entity_id", "true_rul", "rul_pred")
    placed = running_totals(rows, ["model_name"], ["true_rul", "entity_id"], F.lit(1)).withColumnRenamed("upto", "place")
    block = lambda shift: F.floor((F.col("place") - 1 + shift) / SMOOTHED)
    dealt = placed.withColumn("_block", F.explode(F.sequence(block(-after), block(before))))
    w = Window.partitionBy("model_name", "_block").orderBy("place").rowsBetween(-before, after)
    smooth = dealt.withColumn("smooth", F.avg("rul_pred").over(w)).where(F.col("_block") == block(0))
    return smooth.select("model_name", "entity_id", "true_rul", F.col("place").cast("int").alias("place"), "smooth")
