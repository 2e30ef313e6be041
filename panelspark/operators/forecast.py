"""Per-entity time-series fits. Long series are dealt by ranges of steps, whose sums of lag products add up to the fits;
failures give a status, not a gap."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalars import whole_share
from panelspark.operators import grams as G
from panelspark.operators import kernels as K
from panelspark.operators.metrics import modal_value
from panelspark.operators.ranges import MOST_ROWS, OWN, RANGE, known_long, map_run_lists, map_runs, range_cuts, with_halo
from panelspark.operators.ranks import exact_quantiles
from panelspark.operators.windows import acf_table, recent_window, rolling_median
from panelspark.sources.scratch import materialise
from panelspark.spec import PanelSpec

P = PanelSpec()


def _series(df: DataFrame, column: str, spec: PanelSpec) -> DataFrame:
    return df.select(F.col(spec.entity).cast("bigint").alias("entity_id"), F.col(spec.step).alias("step"), F.col(column).cast("double").alias("y"))


def _values(pdf: pd.DataFrame) -> np.ndarray:
    return pdf.sort_values("step")["y"].to_numpy(float)


#: The series of one column, as the functions below name its columns.
_SERIES = PanelSpec(entity="entity_id", step="step")


def _centred(df: DataFrame, column: str, spec: PanelSpec) -> tuple[DataFrame, DataFrame]:
    """Rows (entity_id, step, y less the entity's mean, n), and facts (entity_id, n, mean, ok): what a fit needs to know of
    the whole series. ok: no value is null, NaN or infinite."""
    rows = _series(df, column, spec).withColumn("step", F.col("step").cast("bigint"))
    good = F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") != float("inf"))
    facts = rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(good, F.col("y"))).alias("mean"), F.bool_and(good).alias("ok"))
    return rows.join(facts, "entity_id").select("entity_id", "step", (F.col("y") - F.col("mean")).alias("y"), "n", "ok"), facts


#: Series of up to so many rows are fitted many at a time, each whole.
BATCHED = 2000


def _by_length(df: DataFrame, column: str, spec: PanelSpec, most: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of entities of at most BATCHED rows (and no more than `most`), and the series of longer ones, if there are any.
    Sums over ranges read these several times, so they are written to the shared folder once."""
    least = BATCHED if most is None else min(BATCHED, most)
    if known_long(df, spec, least) is None:
        return df, None
    longer = materialise(df.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least), "longer")
    series = materialise(_series(df.join(longer, spec.entity, "left_semi"), column, spec), "series")
    return df.join(longer, spec.entity, "left_anti"), series


def _whole_runs(df: DataFrame, column: str, spec: PanelSpec, function, schema: str) -> DataFrame:
    """function(ids, centred series, whether all their values are finite) over lists of whole series, as RecordBatches."""

    def each(runs):
        fine = np.array([np.isfinite(c["y"]).all() for c in runs])
        series = [c["y"] - c["y"].mean() if ok else c["y"] for c, ok in zip(runs, fine, strict=True)]
        return function(np.array([c["entity_id"][0] for c in runs], np.int64), series, fine)

    return map_run_lists(_series(df, column, spec).where("entity_id is not null"), ["entity_id"], "step", each, schema)


def _own(c: dict[str, np.ndarray]) -> int:
    """Where a run's own rows begin."""
    return int(np.argmax(c[OWN].astype(bool))) if c[OWN].any() else len(c[OWN])


def _floats(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, float).copy()


def _solved(runs: DataFrame, keys: list[str], values: list[str], function, schema: str) -> DataFrame:
    """function over each series' runs in order: lists of the values, a run for each range (RANGES at most)."""
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = runs.repartition(n, *keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(RANGE, *values))).alias("runs"))

    def solve(batches):
        for batch in batches:
            rows = [y for r in batch.to_pylist() for y in function(r)]
            if rows:
                names = [x.split()[0] for x in schema.split(", ")]
                kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
                arrow = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)])
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    return per.mapInArrow(solve, schema)


def adf_by_entity(df: DataFrame, column: str, spec: PanelSpec = P, most: int | None = MOST_ROWS) -> DataFrame:
    """(entity_id, n, d, tau, status): the first of 0, 1, 2 differences whose unit root is rejected, else 2.

    Every range of a series gives its sums of products of the level, its lagged differences and the difference; their
    totals give all regressions of the test. Series under 10 rows or with values that aren't finite have a status only.
    Series of up to BATCHED rows are tested many at a time.
    """
    schema = "entity_id bigint, n int, d int, tau double, status string"
    df, longer = _by_length(df, column, spec, most)

    def test(ids, series, fine):
        n = np.array([len(y) for y in series])
        use = np.flatnonzero(fine & (n >= 10))
        d, tau, tested = np.zeros(len(n), int), np.full(len(n), np.nan), np.isin(np.arange(len(n)), use)
        d[use], tau[use] = G.adf_many([series[i] for i in use])
        status = np.where(n < 10, "short", np.where(fine, "ok", "not finite"))
        return pa.record_batch([pa.array(ids), pa.array(n, pa.int32()), pa.array(d, pa.int32(), mask=~tested), pa.array(tau, mask=np.isnan(tau)), pa.array(status.tolist())], names=["entity_id", "n", "d", "tau", "status"])

    out = _whole_runs(df, column, spec, test, schema)
    return out if longer is None else out.unionByName(_adf_of_ranges(longer, "y", _SERIES, most))


def _adf_of_ranges(df: DataFrame, column: str, spec: PanelSpec, most: int | None) -> DataFrame:
    """adf_by_entity from sums over ranges."""
    most = known_long(df, spec, most)
    rows, facts = _centred(df, column, spec)
    short = (F.col("n") < 10) | ~F.col("ok")
    most_lags = F.floor(12 * F.pow(F.col("n") / 100, F.lit(0.25)))
    dealt = with_halo(rows.where(~short).drop("ok").withColumn("need", (most_lags + 5).cast("int")), F.col("need"), _SERIES, most)

    def sums(c):
        first, n = _own(c), int(c["n"][0])
        parts = G.adf_sums(c["y"], first, n)
        head = c["y"][first : G.adf_lags(n) + 5] if first < c["need"][0] else c["y"][:0]
        out = [c["entity_id"][:1], c[RANGE][:1], c["n"][:1]]
        return pa.record_batch([*map(pa.array, out), *(pa.array([x.astype(float).tobytes()], pa.binary()) for x in (*parts, head))], names=["entity_id", RANGE, "n", *(f"v{k}" for k in range(7))])

    runs = map_runs(dealt.withColumn(OWN, F.col(OWN).cast("int")), ["entity_id", RANGE], "step", sums, f"entity_id bigint, {RANGE} int, n bigint, " + ", ".join(f"v{k} binary" for k in range(7)))

    def verdict(r):
        n, tau, d = r["n"], None, 2
        head = np.concatenate([_floats(x["v6"]) for x in r["runs"]])
        for k in range(3):
            lags = G.adf_lags(n - k)
            g = sum(_floats(x[f"v{2 * k}"]) for x in r["runs"]).reshape(lags + 3, lags + 3)
            ends = np.array([_floats(x[f"v{2 * k + 1}"]) for x in r["runs"]])
            tau, reject = G.adf_verdict(g, np.diff(head, k), ends[:, 1].max() - ends[:, 0].min(), n - k)
            if reject:
                d = k
                break
        return [(r["entity_id"], n, d, None if np.isnan(tau) else tau, "ok")]

    schema = "entity_id bigint, n int, d int, tau double, status string"
    tested = _solved(runs, ["entity_id", "n"], [f"v{k}" for k in range(7)], verdict, schema)
    rest = facts.where(short).select("entity_id", F.col("n").cast("int").alias("n"), F.lit(None).cast("int").alias("d"), F.lit(None).cast("double").alias("tau"), F.when(F.col("n") < 10, "short").otherwise("not finite").alias("status"))
    return tested.unionByName(rest)


def d_distribution(adf: DataFrame) -> DataFrame:
    """Entities for each d; see modal_value for the commonest."""
    return adf.where("status = 'ok'").groupBy("d").agg(F.count(F.lit(1)).alias("n"))


#: Orders (p, q) that are tried: pure autoregressions, then mixed ones.
AR_ORDERS = tuple((p, 0) for p in range(1, 11))
ARMA_ORDERS = tuple(product(range(1, 4), range(1, 4)))


def order_grid(df: DataFrame, column: str, ps=None, ds=None, qs=None, spec: PanelSpec = P, most: int | None = MOST_ROWS) -> DataFrame:
    """AIC of every order for every entity.

    By default p and q are those of AR_ORDERS and ARMA_ORDERS, and d is the entity's own from adf_by_entity (1 where its
    series is too short for the test); AICs of different d don't compare. Given ps, ds or qs are tried in all combinations.

    One copy of a series serves all orders: its ranges give sums of lag products, from whose totals every autoregression
    and both regressions of every mixed order are solved (grams.Orders). Residuals of mixed orders then take a second
    pass, in which a range tells how they and their squares follow from those before it (grams.filtered). Series of up to
    BATCHED rows take one pass: they are tested and fitted many at a time, each whole (grams.orders_many).
    """
    pairs = [*AR_ORDERS, *ARMA_ORDERS] if ps is None and qs is None else list(product(ps or range(1, 11), qs or range(4)))
    df, longer = _by_length(df, column, spec, most)
    names, told = ["ok", "short", "too short"], len(pairs)

    def fit(ids, series, fine):
        out, use = [], np.flatnonzero(fine)
        if ds is None:
            own, n = np.ones(len(ids), int), np.array([len(y) for y in series])
            tested = np.flatnonzero(fine & (n >= 10))
            own[tested], _ = G.adf_many([series[i] for i in tested])
        for d in [own] if ds is None else [np.full(len(ids), x) for x in ds]:
            aic, failed = np.full((len(ids), told), np.nan), np.full((len(ids), told), 3)
            aic[use], failed[use] = G.orders_many([series[i] for i in use], d[use], pairs)
            values = [round(float(v), 2) if f == 0 else None for v, f in zip(aic.ravel(), failed.ravel(), strict=True)]
            p, q = (np.tile([x[k] for x in pairs], len(ids)) for k in (0, 1))
            columns = [pa.array(np.repeat(ids, told)), pa.array(p, pa.int32()), pa.array(np.repeat(d, told), pa.int32()), pa.array(q, pa.int32()), pa.array(values, pa.float64()), pa.array([[*names, "not finite"][f] for f in failed.ravel()])]
            out.append(pa.record_batch(columns, names=["entity_id", "p", "d", "q", "aic", "status"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    out = _whole_runs(df, column, spec, fit, "entity_id bigint, p int, d int, q int, aic double, status string")
    return out if longer is None else out.unionByName(_orders_of_ranges(longer, "y", pairs, ds, _SERIES, most))


def _orders_of_ranges(df: DataFrame, column: str, pairs: list[tuple[int, int]], ds, spec: PanelSpec, most: int | None) -> DataFrame:
    """order_grid from sums over ranges."""
    mixed = [(p, q) for p, q in pairs if q]
    most_p, most_q = max((p for p, _ in mixed), default=0), max((q for _, q in mixed), default=0)
    most = known_long(df, spec, most)
    rows, facts = _centred(df, column, spec)
    if ds is None:
        own = _adf_of_ranges(df, column, spec, most).select("entity_id", F.coalesce("d", F.lit(1)).alias("d"))
        facts = facts.join(own, "entity_id")
    else:
        facts = facts.withColumn("d", F.explode(F.array(*[F.lit(d) for d in ds])))
    if ds is None or len(ds) > 1:
        rows = rows.join(facts.select("entity_id", "d"), "entity_id")
    else:
        rows = rows.withColumn("d", F.lit(ds[0]))
    longest = F.greatest(F.lit(max(p + q for p, q in pairs)), F.round(F.pow(F.log(F.col("n").cast("double") + 1), F.lit(1.5))) + 1) + most_q + 2
    by = PanelSpec(entity="series", step="step")
    rows = rows.where("ok").drop("ok").withColumn("need", (longest + F.col("d")).cast("int")).withColumn("series", F.concat_ws(":", "entity_id", "d"))
    dealt = with_halo(rows, F.col("need"), by, most).withColumn(OWN, F.col(OWN).cast("int"))
    keys = ["entity_id", "d", RANGE]

    def sums(c):
        first, n, d = _own(c), int(c["n"][0]), int(c["d"][0])
        if n - d < 1:
            g = head = np.zeros(0)
        else:
            lags = G.order_lags(pairs, n - d)
            z = G.lagged(np.diff(c["y"], d), lags, max(lags, first - d))
            g, head = z.T @ z, c["y"][first : lags + d] if first < c["need"][0] else c["y"][:0]
        return pa.record_batch([*(pa.array(c[k][:1]) for k in (*keys, "n")), pa.array([g.tobytes()], pa.binary()), pa.array([head.astype(float).tobytes()], pa.binary())], names=[*keys, "n", "g", "head"])

    runs = map_runs(dealt, keys, "step", sums, f"entity_id bigint, d int, {RANGE} int, n bigint, g binary, head binary")
    width = 5 + 3 + most_p + most_q

    def fits(r):
        """For every order p, q, failure (0: none, 1: short, 2: too short), sum of squares, first residual, and the packed fit."""
        n, d = r["n"] - r["d"], r["d"]
        out = np.zeros((len(pairs), width))
        if n >= 1:
            g = sum(_floats(x["g"]) for x in r["runs"])
            k = int(round(len(g) ** 0.5))
            series = G.Orders(g.reshape(k, k), np.diff(np.concatenate([_floats(x["head"]) for x in r["runs"]]), d), n)
        for i, (p, q) in enumerate(pairs):
            out[i, :2] = p, q
            if n + d <= p + d + q + 5:
                out[i, 2] = 1
                continue
            try:
                c, phi, theta, s, ssr = series.fit(p, q)
                out[i, 3:5] = ssr, s
                if q:
                    out[i, 5:] = G.packed(p, s, c, phi, theta, most_p, most_q)
            except (ValueError, np.linalg.LinAlgError):
                out[i, 2] = 2
        raw = out.tobytes()
        return [(r["entity_id"], d, x[RANGE], n, raw) for x in r["runs"]]

    told = _solved(runs, ["entity_id", "d", "n"], ["g", "head"], fits, f"entity_id bigint, d int, {RANGE} int, n bigint, told binary")

    def final(table: np.ndarray, n: int, chain) -> list:
        found, i = [], 0
        for row in table:
            p, q = int(row[0]), int(row[1])
            value, status = None, ("ok", "short", "too short")[int(row[2])]
            if status == "ok":
                ssr = max(float(chain[1][i, 0, 0]), 0.0) if q else row[3]
                value = round(G.information(ssr / max(n - row[4], 1), n, p, q), 2)
                i += q > 0
            found.append((p, q, value, status))
        return found

    schema = "entity_id bigint, p int, d int, q int, aic double, status string"
    if not mixed:
        out = _solved(told.where(F.col(RANGE) == 0), ["entity_id", "d", "n"], ["told"], lambda r: [(r["entity_id"], p, r["d"], q, v, s) for p, q, v, s in final(_floats(r["runs"][0]["told"]).reshape(-1, width), r["n"], None)], schema)
    else:
        # a run's fits come as its first row
        heads = told.select("entity_id", "d", RANGE, F.lit(-(2**62)).alias("at"), F.lit(0.0).alias("y"), F.lit(1).alias(OWN), F.col("n"), "told")
        data = dealt.select("entity_id", "d", RANGE, F.col("step").alias("at"), "y", OWN, "n", F.lit(None).cast("binary").alias("told"))

        def residuals(c):
            table = _floats(c["told"][0]).reshape(-1, width)
            use = table[(table[:, 1] > 0) & (table[:, 2] == 0), 5:]
            first = int(np.argmax(c[OWN][1:] > 0))
            d = int(c["d"][0])
            step, squares = G.filtered(np.diff(c["y"][1:], d), max(first - d, 0), use, most_p)
            both = [pa.array([x.astype(float).tobytes()], pa.binary()) for x in (step, squares)]
            return pa.record_batch([*(pa.array(c[k][:1]) for k in keys), pa.array(c["n"][:1]), *both, pa.array([c["told"][0]], pa.binary())], names=[*keys, "n", "moved", "squares", "told"])

        moved = map_runs(heads.unionByName(data), keys, "at", residuals, f"entity_id bigint, d int, {RANGE} int, n bigint, moved binary, squares binary, told binary")

        def combined(r):
            k, chain = most_q + 1, None
            for x in r["runs"]:
                part = tuple(_floats(x[name]).reshape(-1, k, k) for name in ("moved", "squares"))
                chain = part if chain is None else G.chained(chain, part)
            return [(r["entity_id"], p, r["d"], q, v, s) for p, q, v, s in final(_floats(r["runs"][0]["told"]).reshape(-1, width), r["n"], chain)]

        out = _solved(moved, ["entity_id", "d", "n"], ["moved", "squares", "told"], combined, schema)
    orders = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in pairs])).alias("o")
    odd = facts.where(~F.col("ok")).select("entity_id", "d", orders).select("entity_id", "o.p", "d", "o.q", F.lit(None).cast("double").alias("aic"), F.lit("not finite").alias("status"))
    return out.unionByName(odd)


def best_orders(grid: DataFrame) -> DataFrame:
    """Each entity's order of least AIC."""
    order = F.struct("p", "d", "q")
    return grid.where("aic is not null").groupBy("entity_id").agg(F.min_by(order, F.struct("aic", order)).alias("o")).select("entity_id", "o.*")


def modal_order(grid: DataFrame, default=(2, 1, 2)) -> DataFrame:
    """I4: the commonest of the entities' best orders, of equally common ones the least; the default where no fit succeeded."""
    counts = best_orders(grid).groupBy("p", "d", "q").agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.min_by(F.struct("p", "d", "q"), F.struct(-F.col("n"), "p", "d", "q")).alias("o"), F.max("n").alias("n"))
    d = F.struct(*[F.lit(v).alias(k) for k, v in zip("pdq", default, strict=True)])
    return best.select(F.coalesce("o", d).alias("o"), F.coalesce("n", F.lit(0)).alias("n")).select("o.*", "n")


def forecast_paths(df: DataFrame, column: str, order=(1, 1, 0), horizon: int = 150, smooth: int = 10, recent: bool = True, spec: PanelSpec = P, most: int | None = MOST_ROWS) -> DataFrame:
    """A row (entity_id, mean, lo, hi) for each entity, arrays of `horizon` steps, forecast from the smoothed recent
    series; entities too short for the order, or with values that aren't finite, give none.

    With `recent` a series is 60 rows at most; without, whole series are fitted, each in one task. Many entities are
    fitted and forecast together.
    """
    p, d, q = order
    most = known_long(df, spec, most)
    rows = rolling_median(df, column, smooth, "_smooth", spec, most)
    if recent:
        rows = recent_window(rows, spec=spec, task_rows=most)
    least = p + d + q + (5 if q == 0 else 3)

    def fit(runs):
        runs = [c for c in runs if len(c["y"]) > least]
        mean, lo, hi, ok = G.forecast_many([c["y"] for c in runs], (p, d, q), horizon)
        if not ok.any():
            return None
        ids = pa.array([c["entity_id"][0] for c in runs], pa.int64()).filter(pa.array(ok))
        ends = pa.array(np.arange(ok.sum() + 1) * horizon, pa.int32())
        return pa.record_batch([ids, *(pa.ListArray.from_arrays(ends, pa.array(x[ok].ravel())) for x in (mean, lo, hi))], names=["entity_id", "mean", "lo", "hi"])

    return map_run_lists(_series(rows, "_smooth", spec), ["entity_id"], "step", fit, "entity_id bigint, mean array<double>, lo array<double>, hi array<double>")


def forecast_by_entity(df: DataFrame, column: str, order=(1, 1, 0), horizon: int = 150, smooth: int = 10, recent: bool = True, spec: PanelSpec = P) -> DataFrame:
    """The paths as rows (entity_id, at, mean, lo, hi)."""
    paths = forecast_paths(df, column, order, horizon, smooth, recent, spec)
    return paths.select("entity_id", F.posexplode(F.arrays_zip("mean", "lo", "hi")).alias("at", "_v")).select("entity_id", "at", "_v.mean", "_v.lo", "_v.hi")


def persistence_walk_forward(df: DataFrame, column: str, share: float = 0.7, least: int = 20, spec: PanelSpec = P) -> DataFrame:
    """I16: one-step forecasts of the rows after the first `share` of an entity, each the value before."""
    w = spec.ordered()
    rows = df.select(spec.entity, spec.step, F.col(column).alias("actual"), F.lag(column).over(w).alias("predicted"), F.row_number().over(w).alias("_k"), F.count(F.lit(1)).over(spec.whole()).alias("_n"))
    return rows.where((F.col("_n") >= least) & (F.col("_k") > whole_share(F.col("_n"), share))).drop("_k", "_n")


def walk_forward(df: DataFrame, column: str, order=(1, 0, 0), share: float = 0.7, window: int = 1, block: int = 16, least: int = 20, spec: PanelSpec = P, most: int | None = MOST_ROWS) -> DataFrame:
    """I16: forecasts of the rows after the first `share`, `window` at a time, with the order refitted on all earlier rows at
    every origin; a fit that fails persists.

    Autoregressions take running sums of lag products: every origin solves the normal equations as of its place, a range
    of a long series begins with the sums of the ranges before it, and each row is shuffled once, with a few rows before
    each range. Orders with moving-average terms, whose shocks depend on each origin's fit, are refitted in blocks of
    `block` origins, each with the whole history before it.
    """
    p, d, q = order
    if q:
        return _walk_in_blocks(df, column, order, share, window, block, least, spec)
    most = known_long(df, spec, most)
    rows, facts = _centred(df, column, spec)
    rows = rows.where(F.col("n") >= least).drop("ok")
    dealt = with_halo(rows, window - 1 + p + d, _SERIES, most).withColumn(OWN, F.col(OWN).cast("int"))
    keys = ["entity_id", RANGE]

    def sums(c):
        first = _own(c)
        z = G.lagged(np.diff(c["y"], d), p, max(p, first - d))
        return pa.record_batch([*(pa.array(c[k][:1]) for k in keys), pa.array([len(c["y"]) - first], pa.int64()), pa.array([(z.T @ z).tobytes()], pa.binary())], names=[*keys, "size", "g"])

    def before(r):
        out, size, g = [], 0, np.zeros((p + 2) ** 2)
        for x in r["runs"]:
            out.append((r["entity_id"], x[RANGE], np.concatenate([[size], g]).tobytes()))
            size, g = size + x["size"], g + _floats(x["g"])
        return out

    data = dealt.select("entity_id", RANGE, F.col("step").alias("at"), "y", OWN, "n", F.lit(None).cast("binary").alias("told"))
    if most is not None:  # what comes before a range is its first row
        long = dealt.join(range_cuts(rows, _SERIES, most).select("entity_id"), "entity_id", "left_semi")
        runs = map_runs(long, keys, "step", sums, f"entity_id bigint, {RANGE} int, size bigint, g binary")
        told = _solved(runs, ["entity_id"], ["size", "g"], before, f"entity_id bigint, {RANGE} int, told binary")
        data = told.select("entity_id", RANGE, F.lit(-(2**62)).alias("at"), F.lit(0.0).alias("y"), F.lit(0).alias(OWN), F.lit(0).cast("bigint").alias("n"), "told").unionByName(data)

    def forecast(c):
        offset, prefix = 0, None
        if c["told"][0] is not None:
            known = _floats(c["told"][0])
            offset, prefix = int(known[0]), known[1:].reshape(p + 2, p + 2)
            c = {k: v[1:] for k, v in c.items()}
        first = _own(c)
        at, value, fitted = G.walk(c["y"], first, offset - (first if prefix is not None else 0), int(c["n"][0]), prefix, p, d, share, window)
        if not len(at):
            return None
        return pa.record_batch([pa.array(c["entity_id"][at]), pa.array(c["at"][at]), pa.array(c["y"][at]), pa.array(value), pa.array(np.where(fitted, "ok", "persistence"))], names=["entity_id", "step", "actual", "predicted", "status"])

    out = map_runs(data, keys, "at", forecast, "entity_id bigint, step bigint, actual double, predicted double, status string")
    mean = facts.select(F.col("entity_id").alias("_e"), "mean")
    return out.join(mean, out["entity_id"] == F.col("_e")).select("entity_id", F.col("step").cast("int").alias("step"), *[(F.col(c) + F.col("mean")).alias(c) for c in ("actual", "predicted")], "status")


def _walk_in_blocks(df: DataFrame, column: str, order, share: float, window: int, block: int, least: int, spec: PanelSpec) -> DataFrame:
    """Refits from scratch, origins dealt in blocks."""
    w = spec.ordered()
    rows = df.select(F.col(spec.entity).cast("bigint").alias("entity_id"), F.col(spec.step).alias("step"), F.col(column).cast("double").alias("y"), F.row_number().over(w).alias("k"), F.count(F.lit(1)).over(spec.whole()).alias("n"))
    rows = rows.where(F.col("n") >= least).withColumn("first", whole_share(F.col("n"), share).cast("int"))
    size = block * window
    blocks = F.sequence(F.greatest(F.lit(0), F.floor((F.col("k") - F.col("first") - 1) / size)).cast("int"), F.floor((F.col("n") - F.col("first") - 1) / size).cast("int"))
    dealt = rows.withColumn("block", F.explode(blocks))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        y, first, b = pdf["y"].to_numpy(float), int(pdf["first"].iloc[0]), int(pdf["block"].iloc[0])
        out = []
        for origin in range(first + b * size, min(first + (b + 1) * size, len(y)), window):
            try:
                values, status = K.forecast(y[:origin], order, window)[0], "ok"
            except (ValueError, np.linalg.LinAlgError):
                values, status = np.repeat(y[origin - 1], window), "persistence"
            out += [(int(pdf["entity_id"].iloc[0]), int(pdf["step"].iloc[at]), y[at], float(v), status) for at, v in zip(range(origin, min(origin + window, len(y))), values, strict=False)]
        return pd.DataFrame(out, columns=["entity_id", "step", "actual", "predicted", "status"])

    return dealt.groupBy("entity_id", "block").applyInPandas(fit, "entity_id bigint, step int, actual double, predicted double, status string")


def walk_forward_rmse(walked: DataFrame, entity: str = "entity_id") -> DataFrame:
    """RMSE of each entity, summed up."""
    per = walked.groupBy(entity).agg(F.sqrt(F.avg((F.col("actual") - F.col("predicted")) ** 2)).alias("rmse"))
    return per.agg(F.count(F.lit(1)).alias("entities"), F.avg("rmse").alias("mean"), F.stddev_pop("rmse").alias("sd"), F.min("rmse").alias("least"), F.max("rmse").alias("most"))


def ljung_box(df: DataFrame, column: str, lags: int = 10, spec: PanelSpec = P) -> DataFrame:
    """Q and its p-value at each lag from the autocorrelations."""
    acf = acf_table(df, column, lags, spec).where("lag > 0")
    w = Window.partitionBy(spec.entity).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("n") * (F.col("n") + 2) * F.sum(F.col("acf") ** 2 / (F.col("n") - F.col("lag"))).over(w)

    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or np.isnan(a) else K.chi2_tail(a, b) for a, b in zip(x, k, strict=True)], dtype="float64")

    return acf.select(spec.entity, "lag", q.alias("q")).withColumn("p", tail("q", F.col("lag")))


def ljung_box_verdict(table: DataFrame, entity: str = "entity_id", level: float = 0.05) -> DataFrame:
    """White noise if no lag fails; late if only lags above 10 do; else early."""
    bad = F.col("p") <= level
    return table.groupBy(entity).agg(F.when(~F.coalesce(F.bool_or(bad), F.lit(False)), "white noise").when(F.min(F.when(bad, F.col("lag"))) > 10, "late").otherwise("early").alias("verdict"))


def residual_profile(residuals: DataFrame, column: str, points: int = 19) -> DataFrame:
    """Pairs of normal and observed quantiles, with mean and deviation."""
    from statistics import NormalDist

    ps = [(k + 1) / (points + 1) for k in range(points)]
    row = residuals.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))
    normal = F.get(F.array(*[F.lit(NormalDist().inv_cdf(p)) for p in ps]), F.col("k"))
    return exact_quantiles(residuals, [], column, ps).crossJoin(F.broadcast(row)).select("mean", "sd", normal.alias("normal"), F.col("value").alias("observed"))  # one row


__all__ = ["adf_by_entity", "best_orders", "d_distribution", "forecast_by_entity", "forecast_paths", "ljung_box", "ljung_box_verdict", "modal_order", "modal_value", "order_grid", "persistence_walk_forward", "residual_profile", "walk_forward", "walk_forward_rmse"]
