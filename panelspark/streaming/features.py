"""Rolling features of a stream of panel rows, with state for each entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rows of the longest tail of the linear estimate.
TAIL = 30
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _trailing(y: np.ndarray, new: int, width: int) -> np.ndarray:
    """The trailing windows of the last `new` places of y, shorter ones padded with NaN on the left."""
    return sliding_window_view(np.concatenate([np.full(max(width - 1, 0), np.nan), y]), width)[len(y) - new :]


def _medians(x: np.ndarray) -> np.ndarray:
    """np.nanmedian of each row, by one sort: NaNs come last."""
    x = np.sort(x, axis=1)
    size, row = (~np.isnan(x)).sum(1), np.arange(len(x))
    return np.where(size > 0, (x[row, np.maximum(size - 1, 0) // 2] + x[row, np.minimum(size // 2, x.shape[1] - 1)]) / 2, np.nan)


def batch_features(held: np.ndarray, y: np.ndarray, n: int, windows, median: int, threshold: float, cap: int) -> dict[str, np.ndarray]:
    """Features of new values y after the held ones; n: how many values the entity had before y."""
    out, every, new = {}, np.concatenate([held, y]), len(y)
    for w in windows:
        x = _trailing(every, new, w)
        size = np.minimum(w, n + 1 + np.arange(new))
        mean = np.nansum(x, axis=1) / size
        out[f"rmean_{w}"] = mean
        out[f"rstd_{w}"] = np.sqrt(np.nansum((x - mean[:, None]) ** 2, axis=1) / np.maximum(size - 1, 1))
    out["median"] = _medians(_trailing(every, new, median))
    count = n + 1 + np.arange(new)
    tail = np.minimum(np.maximum(5, np.minimum(TAIL, (0.2 * count).astype(int))), count)
    x = _trailing(every, new, TAIL)
    at = np.arange(TAIL) - (TAIL - 1) + (tail[:, None] - 1) / 2  # places within the tail, about their middle
    inside = np.arange(TAIL)[None] >= TAIL - tail[:, None]
    slope = np.where(inside, at * np.nan_to_num(x), 0.0).sum(1) / np.maximum(np.where(inside, at**2, 0.0).sum(1), 1e-300)
    flat = (count < 3) | ~(slope > 1e-4)
    out["rul_linear"] = np.where(flat, float(cap), np.clip((threshold - y) / np.where(flat, 1.0, slope), 0, cap))
    return out


#: State of an entity: its count, last step, dropped rows and time to be forgotten, and as many last values as the widest frame needs.
STATE = "n bigint, last bigint, late bigint, timer bigint, kept array<double>"


class PanelFeatures:
    """Rows of one entity in one batch, with its state. With event time an entity that had no row for `idle_ms` is forgotten."""

    def __init__(self, sensor: str, windows, median: int, threshold: float, cap: int, event_time: str | None, idle_ms: int | None):
        self.sensor, self.windows, self.median, self.threshold, self.cap = sensor, tuple(windows), median, threshold, cap
        self.event_time, self.idle_ms = event_time, idle_ms
        self.kept = max(*windows, median, TAIL)

    def __call__(self, key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last, late, timer, held = state.get if state.exists else (0, None, 0, None, ())
        parts = list(rows)
        step = np.concatenate([x["step"].to_numpy(np.int64) for x in parts])
        y = np.concatenate([x[self.sensor].to_numpy(float) for x in parts])
        order = np.argsort(step, kind="stable")
        step, y = step[order], y[order]
        fresh = np.append(True, step[1:] != step[:-1])  # of equal steps the first
        if last is not None:
            fresh &= step > last
        gone = np.cumsum(~fresh)[fresh] + late
        late += int((~fresh).sum())
        step, y = step[fresh], y[fresh]
        held = np.array(held, float)
        if len(y):
            last = int(step[-1])
        if self.event_time and self.idle_ms is not None:
            newest = max(pd.Timestamp(x[self.event_time].max()) for x in parts)
            at = int(newest.value // 1_000_000) + self.idle_ms
            timer = at if timer is None else max(at, timer)
            state.setTimeoutTimestamp(timer)
        state.update((n + len(y), last, late, timer, [float(v) for v in np.concatenate([held, y])[-self.kept :]]))
        if len(y):
            out = batch_features(held, y, n, self.windows, self.median, self.threshold, self.cap)
            columns = {"entity_id": np.full(len(y), key[0]), "step": step} | {f"{self.sensor}_{k}" if k != "rul_linear" else k: v for k, v in out.items()} | {"late": gone}
            yield pd.DataFrame(columns)


def stream_panel_features(rows: DataFrame, sensor: str, windows=(5, 10, 20), median: int = 10, threshold: float = 1.0, cap: int = 125, event_time: str | None = None, delay: str = "10 minutes", idle: str | None = None) -> DataFrame:
    """K1: for each new row rolling means and sample deviations, the trailing median and the linear remaining life.

    rows: a streaming DataFrame of (entity_id bigint, step int or bigint, sensor double), and a timestamp column if
    event_time is given. A row at or below an entity's last emitted step is dropped, and `late` tells how many were so
    far. With event_time, rows behind the watermark (`delay` behind the newest) are dropped by it, and with `idle` (an
    interval) an entity that has had no row for so long of event time is forgotten: a later row begins anew. Results
    equal the batch operators' on the same rows. State comes and goes with the rows of many entities at a time
    (applyInPandasWithState), without a call for each entity's; it is kept in the RocksDB store, which is set on the session.
    """
    spark = rows.sparkSession
    spark.conf.set(_STORE, _ROCKS)
    kind = rows.schema["step"].dataType.simpleString()
    names = [f"{sensor}_{k}_{w}" for w in windows for k in ("rmean", "rstd")]
    schema = "entity_id bigint, step bigint, " + ", ".join(f"{n} double" for n in names) + f", {sensor}_median double, rul_linear double, late bigint"
    columns = ["entity_id", F.col("step").cast("bigint").alias("step"), F.col(sensor).cast("double").alias(sensor)]
    idle_ms = None
    if event_time:
        rows = rows.withWatermark(event_time, delay)
        columns.append(F.col(event_time))
        if idle:
            idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    processor = PanelFeatures(sensor, windows, median, threshold, cap, event_time, idle_ms)
    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout
    out = rows.select(*columns).groupBy("entity_id").applyInPandasWithState(processor, schema, STATE, "append", timeout)
    return out.withColumn("step", F.col("step").cast(kind))
