"""Registered panel queries, each with SQL that DuckDB can run where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions import scalars as S
from panelspark.operators import crossing, forecast, health, intervals, label, learn, metrics, quality, regimes, windows
from panelspark.plans import fleet
from panelspark.sources import panels, scratch, tables, text
from panelspark.spec import PanelSpec
from panelspark.streaming import features

P = PanelSpec()
P40 = PanelSpec(sensors=("s1", "s2", "s3"), cap=40)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def lines(s, d):
    return label.label_rul_train(panels.lineitem_panel(s, d))


def events(s, d):
    return label.label_rul_train(panels.events_panel(s, d), P40)


def health_panel(s, d):
    return panels.fixed_health(lines(s, d))


def cut_panel(s, d):
    return label.truncate_histories(health_panel(s, d)).drop("rul_last")


def train(df):
    return df.where(~panels.is_test())


def test(df):
    return df.where(panels.is_test())


def predictions(s, d):
    return panels.two_models(panels.lineitem_panel(s, d))


def observed(s, d):
    """Facts of truncated histories with the threshold of train rows near their end."""
    h = health_panel(s, d)
    t = health.failure_threshold(train(h), 0.05, index="hi")
    return crossing.with_parameters(crossing.observed(cut_panel(s, d), "hi"), t, None, P.cap)


# --- SQL building blocks -----------------------------------------------------------------------------------------

_P = """p as (select l_suppkey as entity_id, cast(row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber,
        l_partkey, l_extendedprice, l_quantity, l_discount) as int) as step, concat(l_returnflag, l_linestatus) as regime,
        l_discount as op1, l_tax as op2, l_quantity as s1, l_extendedprice as s2, l_discount as s3, l_tax as s4 from lineitem)"""
_L = _P + """, lab as (select *, cast(least(max(step) over (partition by entity_id) - step, 125) as int) as rul from p)"""
_E = """p as (select user_id as entity_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as step, event_type as regime,
        value as s1, cast(json_extract_string(props, '$.k') as double) as s2,
        coalesce((epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1e6, 0) as s3 from events),
        lab as (select *, cast(least(max(step) over (partition by entity_id) - step, 40) as int) as rul from p)"""
_H = _L + """, par as (select regime, avg(s1) as m1, stddev_pop(s1) as d1, avg(s2) as m2, stddev_pop(s2) as d2 from p where entity_id % 5 <> 0 group by regime),
        h as (select lab.*, 0.6 * (s1 - m1) / d1 + 0.4 * (s2 - m2) / d2 + 0.01 * step as hi from lab join par using (regime))"""
_CUT = """, c0 as (select *, count(*) over (partition by entity_id) as n from h),
        c1 as (select *, greatest(10, floor(n * 0.2)) as lo from c0 where n >= 20),
        c2 as (select *, least(greatest(lo + 1, floor(n * 0.9) + 1), n) as up from c1),
        cut as (select entity_id, step, regime, s1, s2, s3, s4, rul, hi from c2 where step <= lo + (entity_id * 7919 + 42) % cast(up - lo as bigint))"""
_OBS = _H + _CUT + """, o0 as (select *, row_number() over (partition by entity_id order by step desc) as k, count(*) over (partition by entity_id) as n from cut),
        o1 as (select entity_id, count(*) as n, max_by(hi, step) as last,
                 regr_slope(case when k <= greatest(least(floor(n * 0.2), 30), 5) then hi end, step) as slope_long,
                 regr_slope(case when k <= greatest(least(floor(n / 4), 15), 5) then hi end, step) as slope_short, max_by(rul, step) as true_rul
               from o0 group by entity_id),
        th as (select quantile_cont(hi, 0.05) as threshold from h where entity_id % 5 <> 0 and rul <= 5),
        obs as (select *, 125.0 as fallback,
                  case when n < 3 or coalesce(slope_long, 0) <= 1e-4 then 125.0 else least(greatest((threshold - last) / slope_long, 0), 125) end as ext_long,
                  case when n < 3 or coalesce(slope_short, 0) <= 1e-4 then 125.0 else least(greatest((threshold - last) / slope_short, 0), 125) end as ext_short
                from o1 cross join th)"""
_PATH = _OBS + """, path as (select entity_id, i, last + coalesce(slope_long, 0) * (i + 1) as mean,
                    last + coalesce(slope_long, 0) * (i + 1) - 0.1 * sqrt(i + 1) as lo, last + coalesce(slope_long, 0) * (i + 1) + 0.1 * sqrt(i + 1) as hi
                  from obs, unnest(range(150)) as r(i))"""
_T = _P + """, n as (select entity_id, max(step) as n from p group by entity_id),
        b as (select entity_id, n, greatest(10, cast(floor(n * 0.75) as int)) as lo from n),
        hh as (select entity_id, n, lo, least(greatest(lo + 1, cast(floor(n * 0.99) as int) + 1), n) as up from b),
        k as (select entity_id, n, cast(lo + (entity_id * 7919 + 42) % (up - lo) as int) as cut from hh),
        q as (select quantile_cont(n, 0.1) as a, quantile_cont(n, 0.5) as m, quantile_cont(n, 0.9) as z from n where entity_id % 5 <> 0),
        one as (select k.entity_id, 'lifetime_table' as model_name, cast(least(n - cut, 125) as double) as true_rul,
                  cast(least(greatest(m - cut, 0), 125) as double) as rul_pred, cast(least(greatest(a - cut, 0), 125) as double) as lower_bound,
                  cast(least(greatest(z - cut, 0), 125) as double) as upper_bound from k cross join q where entity_id % 5 = 0),
        t as (select * from one union all select entity_id, 'half_cap', true_rul, 62.5, 0.0, 125.0 from one)"""
_D = "greatest(least({p} - {t}, 100), -100)"
_PEN = "(case when {d} < 0 then exp(-{d} / 13) - 1 else exp({d} / 10) - 1 end)"


def pen(t="true_rul", p="rul_pred"):
    d = _D.format(p=p, t=t)
    return _PEN.format(d=d)


def evaluated(source: str, by: str, p="rul_pred", t="true_rul", digits: int = 4) -> str:
    return f"""select {by}, count(*) as n, round(sqrt(avg(pow({t} - {p}, 2))), {digits}) as rmse, round(sum({pen(t, p)}), {digits}) as score,
        round(sum({pen(t, p)}) / count(*), {digits}) as score_mean,
        round(1 - sum(pow({t} - {p}, 2)) / nullif(var_pop({t}) * count(*), 0), {digits}) as r2, round(avg({p} - {t}), {digits}) as bias from {source} group by {by}"""


SENSORS = ("s1", "s2", "s3", "s4")


def each(template: str, sensors=SENSORS) -> str:
    return " union all ".join(template.format(s=s) for s in sensors)


# --- sources, predicates, joins -----------------------------------------------------------------------------------


@query(f"with {_L} select entity_id, step, cast(least(7 + max(step) over (partition by entity_id) - step, 125) as int) as rul from lab")
def label_rul_test(s, d):
    held = panels.lineitem_panel(s, d).withColumn("rul_last", F.lit(7))
    return label.label_rul_test(held).select("entity_id", "step", "rul")


@query(f"with {_P}, tr as (select entity_id, max(step) % 50 as rul_last from p group by entity_id) select p.entity_id, count(*) as n, max(rul_last) as rul_last from p join tr using (entity_id) group by p.entity_id")
def read_truth_join(s, d):
    p = panels.lineitem_panel(s, d)
    truth = quality.lifetimes(p).select("entity_id", (F.col("lifetime") % 50).alias("rul_last"))
    return p.join(truth, "entity_id").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.max("rul_last").alias("rul_last"))


@query(f"with {_P}, tr as (select entity_id, cast(max(step) % 50 as int) as rul_last from p group by entity_id) select p.entity_id, count(*) as n, max(rul_last) as rul_last from p join tr using (entity_id) group by p.entity_id")
def read_truth_text(s, d):
    """Truth values written as text in entity order, read line by line and met with their entities."""
    p = panels.lineitem_panel(s, d)
    folder = scratch.scratch_path(s, "truth")
    quality.lifetimes(p).orderBy("entity_id").select((F.col("lifetime") % 50).cast("string").alias("value")).write.text(folder)
    out = text.attach_truth(p, text.read_truth_text(s, folder), "entity_id")
    return out.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.max("rul_last").alias("rul_last"))


@query(f"with {_L} select sensor, round(sd, 6) as sd from ({each('''select '{s}' as sensor, stddev_samp({s}) as sd from lab where entity_id % 5 <> 0''')}) where sd < 0.1")
def low_variance_sensors(s, d):
    return rounded(quality.low_variance_sensors(train(lines(s, d))))


@query(f"""with {_L} select sensor, round(variance, 2) as variance, round(corr_rul, 6) as corr_rul,
    case when variance < 1e-10 then 'drop' when variance < 0.1 then 'borderline' else 'keep' end as decision
    from ({each("select '{s}' as sensor, var_samp({s}) as variance, covar_pop({s}, rul) / nullif(stddev_pop({s}) * stddev_pop(rul), 0) as corr_rul from lab")})""")
def sensor_profile(s, d):
    return rounded(quality.sensor_profile(lines(s, d)).withColumn("variance", F.round("variance", 2)))


@query(f"with {_L} select sensor, true as in_train, true as in_test from ({each('''select '{s}' as sensor, stddev_samp({s}) as sd from lab where entity_id % 5 <> 0''')}) where sd < 0.1")
def drop_sensor_decision(s, d):
    p = lines(s, d)
    return quality.drop_sensor_decision(train(p), test(p))


@query(f"""with {_P}, l as (select entity_id, max(step) as lifetime from p group by entity_id)
    select count(*) as entities, round(avg(lifetime), 6) as mean, round(stddev_samp(lifetime), 6) as sd, min(lifetime) as least, round(quantile_cont(lifetime, 0.25), 6) as q25,
    round(quantile_cont(lifetime, 0.5), 6) as q50, round(quantile_cont(lifetime, 0.75), 6) as q75, max(lifetime) as most, min(lifetime) > 125 as cap_binds from l""")
def lifetime_profile(s, d):
    return rounded(quality.lifetime_profile(panels.lineitem_panel(s, d)))


@query(f"""with {_P}, l as (select entity_id, cast(max(step) as int) as lifetime from p group by entity_id),
    r as (select *, row_number() over (order by lifetime, entity_id) as k, count(*) over () as n from l)
    select entity_id, lifetime, case when k = 1 then 'shortest' when k = floor(n / 2) + 1 then 'median' else 'longest' end as role from r where k in (1, floor(n / 2) + 1, n)""")
def representative_entities(s, d):
    return quality.representative_entities(panels.lineitem_panel(s, d))


@query(f"""with {_P}, w as (select regime, {", ".join(f"stddev_samp({x}) as {x}" for x in SENSORS)} from p group by regime)
    select o.sensor, round(overall, 6) as overall, round(within, 6) as within from ({each("select '{s}' as sensor, stddev_samp({s}) as overall from p")}) o
    join ({each("select '{s}' as sensor, avg({s}) as within from w")}) i using (sensor)""")
def std_within_vs_overall(s, d):
    return rounded(quality.std_within_vs_overall(panels.lineitem_panel(s, d)))


_CENTRES = [[0.02, 0.02], [0.02, 0.06], [0.05, 0.04], [0.08, 0.02], [0.08, 0.06]]
_NEAREST = "list_position([{0}], list_min([{0}])) - 1".format(", ".join(f"0.0 + pow(op1 - {a}, 2) + pow(op2 - {b}, 2)" for a, b in _CENTRES))


def clustered(s, d):
    return regimes.assign_regimes(panels.lineitem_panel(s, d), _CENTRES)


_C = _P + f", c as (select *, cast({_NEAREST} as int) as op_cluster from p)"


@query(f"with {_C} select entity_id, step, op_cluster from c")
def assign_fixed_centres(s, d):
    return clustered(s, d).select("entity_id", "step", "op_cluster")


@query(f"with {_C} select regime, op_cluster, count(*) as n from c group by 1, 2")
def regime_crosstab(s, d):
    return regimes.regime_crosstab(clustered(s, d), "regime", "op_cluster")


@query(f"with {_C}, x as (select regime, op_cluster, count(*) as n from c group by 1, 2), s as (select regime, max(n) / sum(n) as share from x group by 1) select round(avg(share), 6) as dominance, avg(share) >= 0.95 as passes from s")
def regime_dominance(s, d):
    return rounded(regimes.regime_dominance(regimes.regime_crosstab(clustered(s, d), "regime", "op_cluster"), "regime"))


@query(f"with {_C} select op_cluster, count(*) as n from c group by 1")
def cluster_sizes(s, d):
    return regimes.cluster_sizes(clustered(s, d), "op_cluster")


@query(f"""with {_C}, x as (select regime, op_cluster, count(*) as n from c group by 1, 2), f as (select
    (select sum(n * (n - 1) / 2.0) from x) as ij, (select sum(n * (n - 1) / 2.0) from (select sum(n) as n from x group by regime)) as i,
    (select sum(n * (n - 1) / 2.0) from (select sum(n) as n from x group by op_cluster)) as j, (select sum(n) * (sum(n) - 1) / 2.0 from x) as t)
    select round((ij - i * j / t) / nullif((i + j) / 2 - i * j / t, 0), 6) as ari from f""")
def adjusted_rand_index(s, d):
    return rounded(regimes.adjusted_rand_index(regimes.regime_crosstab(clustered(s, d), "regime", "op_cluster"), "regime", "op_cluster"))


@query(f"with {_C} select entity_id, step, s1, op_cluster from c")
def cluster_labels_join(s, d):
    return regimes.cluster_labels_join(panels.lineitem_panel(s, d), clustered(s, d), "op_cluster").select("entity_id", "step", "s1", "op_cluster")


@query(f"""with {_P}, k as (select *, concat_ws('_', cast(round_even(op1, 1) as varchar), cast(round_even(op2, 1) as varchar)) as key from p)
    select dense_rank() over (order by key) as op_cluster, count(*) as n from k group by key""")
def regimes_by_rounding(s, d):
    return regimes.regimes_by_rounding(panels.lineitem_panel(s, d)).groupBy("op_cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("op_cluster", F.col("op_cluster").cast("bigint"))


_QS = ", ".join(f"quantile_cont({x}, 0.25) as {x}_a, quantile_cont({x}, 0.75) as {x}_b" for x in SENSORS)
_BOUNDS = f"q4 as (select regime, {_QS} from p where entity_id % 5 <> 0 group by regime), bo as ({each('''select '{s}' as sensor, min({s}_a - 0.2 * ({s}_b - {s}_a)) as lo, max({s}_b + 0.2 * ({s}_b - {s}_a)) as hi from q4''')})"


def bounds(s, d):
    return quality.outlier_bounds(train(panels.lineitem_panel(s, d)), 0.2)


@query(f"with {_P}, {_BOUNDS} select sensor, round(lo, 6) as lo, round(hi, 6) as hi from bo")
def outlier_bounds(s, d):
    return rounded(bounds(s, d))


@query(f"""with {_P}, {_BOUNDS}, w as (select {", ".join(f"max(case when sensor = '{x}' then {v} end) as {x}_{v}" for x in SENSORS for v in ("lo", "hi"))} from bo)
    select entity_id, step, {", ".join(f"round(least(greatest({x}, {x}_lo), {x}_hi), 6) as {x}" for x in SENSORS)},
    cast({" + ".join(f"cast({x} < {x}_lo or {x} > {x}_hi as int)" for x in SENSORS)} as int) as n_clipped from p cross join w""")
def outlier_clip(s, d):
    return rounded(quality.clip_outliers(panels.lineitem_panel(s, d), bounds(s, d)).select("entity_id", "step", *SENSORS, "n_clipped"))


_STATS = ", ".join(f"avg({x}) as {x}_mean, case when stddev_pop({x}) = 0 then 1 else stddev_pop({x}) end as {x}_std" for x in SENSORS)
_PARS = f"ps as (select regime, {_STATS} from p where entity_id % 5 <> 0 group by regime)"


@query(f"with {_P}, {_PARS} select regime, {', '.join(f'round({x}_{v}, 6) as {x}_{v}' for x in SENSORS for v in ('mean', 'std'))} from ps")
def regime_scaler_fit(s, d):
    return rounded(regimes.regime_parameters(train(panels.lineitem_panel(s, d)), SENSORS))


def scaled(s, d):
    p = lines(s, d)
    return regimes.apply_regime_scaler(p, regimes.regime_parameters(train(p), SENSORS), SENSORS, check=False)


_SC = f"{_L}, {_PARS}, sc as (select entity_id, step, regime, rul, {', '.join(f'({x} - {x}_mean) / {x}_std as {x}' for x in SENSORS)} from lab join ps using (regime))"


@query(f"with {_SC} select entity_id, step, {', '.join(f'round({x}, 6) as {x}' for x in SENSORS)} from sc")
def regime_scaler_apply(s, d):
    return rounded(scaled(s, d).select("entity_id", "step", *SENSORS))


@query(f"with {_SC}, e as ({each('''select regime, '{s}' as sensor, avg({s}) as mean, stddev_pop({s}) as sd from sc where entity_id % 5 = 0 group by regime''')}) select regime, sensor, round(mean, 6) as mean, round(sd, 6) as sd from e where abs(mean) >= 0.01 or sd <= 0")
def scaling_violations(s, d):
    return rounded(quality.scaling_violations(test(scaled(s, d)), 0.01))


@query(f"""with {_P}, z as (select *, case when regime = 'AF' then 1.0 else s1 end as s5 from p), w as (select regime, {", ".join(f"stddev_samp({x}) as {x}" for x in (*SENSORS, "s5"))} from z group by regime)
    select sensor, regimes from ({each("select '{s}' as sensor, count_if({s} = 0) as regimes from w", (*SENSORS, "s5"))}) where regimes > 0""")
def dead_sensors(s, d):
    p = panels.lineitem_panel(s, d).withColumn("s5", F.when(F.col("regime") == "AF", 1.0).otherwise(F.col("s1")))
    return quality.dead_sensors(p, PanelSpec(sensors=(*SENSORS, "s5")))


@query(f"with {_L} select entity_id, step, rul from lab")
def label_rul_train(s, d):
    return lines(s, d).select("entity_id", "step", "rul")


@query(f"with {_L}, z as (select entity_id, step, case when entity_id % 7 = 0 then rul - 3 else rul end as rul, max(step) over (partition by entity_id) as m from lab) select entity_id, step, rul from z where rul < 0 or rul > 125 or (step = m and rul <> 0)")
def label_violations(s, d):
    spoiled = lines(s, d).withColumn("rul", F.when(F.col("entity_id") % 7 == 0, F.col("rul") - 3).otherwise(F.col("rul")))
    return label.label_violations(spoiled)


@query(f"with {_L}, b as (select entity_id, step, case when step % 100 = 0 then rul + 1 else rul end as rul from lab where step % 97 <> 0) select count(b.step) as matched, count_if(b.step is not null and b.rul <> lab.rul) as changed, count_if(b.step is null) as lost from lab left join b using (entity_id, step)")
def label_integrity_join(s, d):
    p = lines(s, d)
    other = p.where(F.col("step") % 97 != 0).withColumn("rul", F.when(F.col("step") % 100 == 0, F.col("rul") + 1).otherwise(F.col("rul")))
    return quality.label_integrity(p, other)


@query(f"with {_L}, k as (select *, row_number() over (partition by entity_id order by step desc) as k from lab) select entity_id, step, regime, round(s2, 6) as s2, rul from k where k = 1")
def last_row_per_entity(s, d):
    return label.last_rows(lines(s, d)).select("entity_id", "step", "regime", F.round("s2", 6).alias("s2"), "rul")


@query(f"with {_P}, k as (select *, dense_rank() over (order by entity_id) as k from p) select entity_id, count(*) as n from k where k <= 15 group by 1")
def first_n_entities(s, d):
    return label.first_entities(panels.lineitem_panel(s, d), 15).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_H}{_CUT} select entity_id, cast(max(step) as int) as last_step, count(*) as n from cut group by 1""")
def truncate_histories(s, d):
    return cut_panel(s, d).groupBy("entity_id").agg(F.max("step").alias("last_step"), F.count(F.lit(1)).alias("n"))


@query(f"""with {_P}, i as (select distinct entity_id from p), k as (select entity_id, row_number() over (order by (entity_id * 7919 + 42) % 10007, entity_id) as k, count(*) over () as n from i)
    select entity_id, case when k <= floor(n * 0.8) then 'train' else 'valid' end as part from k""")
def entity_split(s, d):
    return label.entity_split(panels.lineitem_panel(s, d))


# --- windows ------------------------------------------------------------------------------------------------------


def _roll(sensors, ws):
    return ", ".join(
        f"round(avg({x}) over (partition by entity_id order by step rows {w - 1} preceding), 6) as {x}_rmean_{w}, round(coalesce(stddev_samp({x}) over (partition by entity_id order by step rows {w - 1} preceding), 0), 6) as {x}_rstd_{w}"
        for x in sensors for w in ws
    )


@query(f"with {_E} select entity_id, step, {_roll(('s1', 's2'), (5, 10, 20))} from lab")
def rolling_features(s, d):
    out = windows.rolling_features(events(s, d), spec=PanelSpec(sensors=("s1", "s2"), cap=40))
    return rounded(out.select("entity_id", "step", *[c for c in out.columns if "_r" in c]))


@query(f"with {_E} select entity_id, step from lab where step = 1 and entity_id % 3 = 0")
def rolling_violations(s, d):
    out = windows.rolling_features(events(s, d), (5,), P40)
    spoiled = out.withColumn("s1_rstd_5", F.when(F.col("entity_id") % 3 == 0, F.col("s1_rstd_5") + 1).otherwise(F.col("s1_rstd_5")))
    return windows.rolling_violations(spoiled, [c for c in out.columns if "_r" in c], P40)


@query(f"with {_E} select entity_id, step, round(quantile_cont(s1, 0.5) over (partition by entity_id order by step rows 9 preceding), 6) as s1_median from lab")
def rolling_median(s, d):
    return rounded(windows.rolling_median(events(s, d), "s1", 10, spec=P40).select("entity_id", "step", "s1_median"))


@query(f"with {_E}, k as (select *, row_number() over (partition by entity_id order by step desc) as k, count(*) over (partition by entity_id) as n from lab) select entity_id, min(step) as first_step, count(*) as n from k where k <= least(greatest(round_even(n * 0.3, 0), 20), 60) group by 1")
def recent_window(s, d):
    return windows.recent_window(events(s, d), spec=P40).groupBy("entity_id").agg(F.min("step").alias("first_step"), F.count(F.lit(1)).alias("n"))


@query(f"with {_E}, a as (select *, s1 - lag(s1) over (partition by entity_id order by step) as d1 from lab) select entity_id, step, round(d2, 6) as diff from (select *, d1 - lag(d1) over (partition by entity_id order by step) as d2 from a) where step > 2")
def difference_d2(s, d):
    return rounded(windows.difference(events(s, d), "s1", 2, P40).select("entity_id", "step", "diff"))


@query(f"with {_E} select entity_id, step, round(s1, 6) as value from lab where step > 1")
def undifference(s, d):
    e = events(s, d)
    seeds = e.where("step = 1").select("entity_id", F.col("s1").alias("level"))
    return rounded(windows.undifference(windows.difference(e, "s1", 1, P40), seeds, 1, P40).select("entity_id", "step", "value"))


@query(f"""with {_L}, b as (select *, cast(greatest(ceil(round((step - min(step) over w) * 1.0 / nullif(max(step) over w - min(step) over w, 0) * 20, 9)) - 1, 0) as int) as bin from lab window w as (partition by entity_id))
    select bin, {", ".join(f"round(avg({x}), 6) as {x}" for x in SENSORS)}, count(*) as n from b group by bin""")
def life_bins(s, d):
    return rounded(windows.life_bins(lines(s, d)))


_ACF = """x as (select entity_id, step, s1 - avg(s1) over (partition by entity_id) as x, count(*) over (partition by entity_id) as n from lab),
    ac as (select a.entity_id, b.step - a.step as lag, max(a.n) as n, sum(a.x * b.x) as num from x a join x b on a.entity_id = b.entity_id and b.step - a.step between 0 and 10 group by 1, 2),
    acf as (select ac.entity_id, ac.lag, ac.n, ac.num / nullif(z.num, 0) as acf from ac join ac z on z.entity_id = ac.entity_id and z.lag = 0)"""


@query(f"with {_E}, {_ACF} select entity_id, cast(lag as int) as lag, n, round(acf, 6) as acf from acf")
def acf_table(s, d):
    return rounded(windows.acf_table(events(s, d), "s1", 10, P40))


@query(f"with {_E}, {_ACF}, q as (select a.entity_id, a.lag, a.n * (a.n + 2) * sum(b.acf * b.acf / (b.n - b.lag)) as q from acf a join acf b on a.entity_id = b.entity_id and b.lag between 1 and a.lag where a.lag > 0 group by a.entity_id, a.lag, a.n) select entity_id, cast(lag as int) as lag, round(q, 5) as q from q")
def ljung_box_q(s, d):
    return rounded(forecast.ljung_box(events(s, d), "s1", 10, P40).select("entity_id", "lag", "q"), 5)


@query(f"""with {_E}, w as (select entity_id, step, rul, array_agg([s1, s2]) over (partition by entity_id order by step rows 29 preceding) as a from lab)
    select entity_id, step, len(flatten(a)) as size, round(list_sum(flatten(a)), 5) as total, round(flatten(a)[1], 6) as first, cast(rul as double) as label from w where step >= 30""")
def window_arrays(s, d):
    out = windows.window_arrays(events(s, d), ["s1", "s2"], 30, spec=P40)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return out.select("entity_id", "step", F.size("features").cast("bigint").alias("size"), F.round(total, 5).alias("total"), F.round(F.col("features")[0], 6).alias("first"), "label")


_PADDED = """w as (select entity_id, step, rul, flatten(array_agg([s1, s2]) over (partition by entity_id order by step rows 59 preceding)) as a, count(*) over (partition by entity_id) as n,
    first_value(rul) over (partition by entity_id order by step) as r1 from lab)"""


def _told(out):
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return out.select("entity_id", "step", F.size("features").cast("bigint").alias("size"), F.round(total, 5).alias("total"), F.round(F.col("features")[0], 6).alias("first"), "label")


@query(f"with {_E}, {_PADDED} select entity_id, step, cast(120 as bigint) as size, round(list_sum(a), 5) as total, round(case when n < 60 then 0.0 else a[1] end, 6) as first, cast(case when n < 60 then r1 else rul end as double) as label from w where step >= 60 or (n < 60 and step = n)")
def window_arrays_padded(s, d):
    return _told(windows.window_arrays(events(s, d), ["s1", "s2"], 60, spec=P40))


@query(f"with {_E}, {_PADDED} select entity_id, step, cast(120 as bigint) as size, round(list_sum(a), 5) as total, round(case when n < 60 then 0.0 else a[1] end, 6) as first, cast(rul as double) as label from w where step = n")
def window_arrays_last(s, d):
    return _told(windows.window_arrays(events(s, d), ["s1", "s2"], 60, True, P40))


@query(f"with {_T} select model_name, entity_id, true_rul, cast(row_number() over w as int) as place, round(avg(rul_pred) over (partition by model_name order by true_rul, entity_id rows between 5 preceding and 4 following), 6) as smooth from t window w as (partition by model_name order by true_rul, entity_id)")
def sorted_smoothing(s, d):
    return rounded(windows.sorted_smoothing(predictions(s, d)))


_FRAME = "over (partition by user_id order by ts rows {} preceding)"


@query(f"""select user_id as entity_id, epoch_us(ts) as step, {", ".join(f"round(avg(value) {_FRAME.format(w - 1)}, 6) as s1_rmean_{w}, round(coalesce(stddev_samp(value) {_FRAME.format(w - 1)}, 0), 6) as s1_rstd_{w}" for w in (5, 10, 20))},
    round(quantile_cont(value, 0.5) {_FRAME.format(9)}, 6) as s1_median, cast(0 as bigint) as late from events""")
def stream_features(s, d):
    """The table of events as a stream, run to its end, into a table of the shared folder."""
    path = f"{d}/events.parquet"
    stream = s.readStream.schema(s.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")  # a pattern, as the table may be one file
    at = F.col("ts").cast("timestamp")
    rows = stream.select(F.col("user_id").cast("bigint").alias("entity_id"), F.unix_micros(at).alias("step"), F.col("value").alias("s1"), at.alias("at"))
    out = features.stream_panel_features(rows, "s1", event_time="at", delay="1 day", idle="365 days")
    folder = scratch.scratch_path(s, "stream")
    out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return rounded(s.read.parquet(f"{folder}/rows").drop("rul_linear"))


# --- health index and crossing --------------------------------------------------------------------------------------

_CORR = _L + f", cr as ({each('''select '{s}' as sensor, round_even(covar_pop({s}, -rul) / nullif(stddev_pop({s}) * stddev_pop(-rul), 0), 4) as r from lab''')})"


@query(f"with {_CORR} select sensor, r, abs(r) >= 0.0 as kept from cr")
def degradation_corr(s, d):
    return health.degradation_corr(lines(s, d), 0.0)


@query(f"with {_CORR} select sensor, r from cr order by abs(r) desc, sensor limit 5")
def top5_sensors(s, d):
    return metrics.top_sensors(health.degradation_corr(lines(s, d), 0.0)).select("sensor", "r")


@query(f"with {_H} select entity_id, step, round(hi, 6) as hi from h")
def health_index_fixed(s, d):
    return rounded(health_panel(s, d).select("entity_id", "step", "hi"))


@query(f"with {_H} select round(1 - sum(pow(-rul - hi, 2)) / nullif(var_pop(rul) * count(*), 0), 6) as r2 from h")
def health_index_r2(s, d):
    return rounded(health.health_index_r2(health_panel(s, d), "hi"))


@query(f"with {_SC} select entity_id, step, round((s1 + s2 + s3 + s4) / 4, 6) as health_index from sc")
def top5_mean_index(s, d):
    return rounded(health.top5_mean_index(scaled(s, d)).select("entity_id", "step", "health_index"))


@query(f"""with {_SC}, {_H[len(_L) + 2:]},
    a as (select 1 - sum(pow(-rul - hi, 2)) / (var_pop(rul) * count(*)) as r2 from h), b as (select 1 - sum(pow(-rul - (s1 + s2 + s3 + s4) / 4, 2)) / (var_pop(rul) * count(*)) as r2 from sc)
    select 'index' as component, 'weighted' as variant, round(r2, 6) as metric, 0.0 as delta, 'negligible' as verdict from a
    union all select 'index', 'mean of five', round(b.r2, 6), round(b.r2 - a.r2, 6), case when abs(b.r2 - a.r2) < 0.01 then 'negligible' when b.r2 > a.r2 then 'better' else 'worse' end from a, b""")
def ablation_table(s, d):
    a = health.health_index_r2(health_panel(s, d), "hi")
    b = health.health_index_r2(health.top5_mean_index(scaled(s, d)))
    return rounded(health.ablation_table([("index", "weighted", a), ("index", "mean of five", b)], "r2", False))


@query(f"with {_H} select round(quantile_cont(hi, 0.05), 6) as threshold from h where entity_id % 5 <> 0 and rul <= 5")
def failure_threshold(s, d):
    return rounded(health.failure_threshold(train(health_panel(s, d)), 0.05, index="hi"))


@query(f"with {_H}, k as (select *, row_number() over (partition by entity_id order by step) - 1 as k, count(*) over (partition by entity_id) as n from h where entity_id % 5 <> 0) select round(regr_slope(rul, hi), 6) as slope, round(regr_intercept(rul, hi), 6) as intercept, round(regr_r2(rul, hi), 6) as r2 from k where k >= greatest(floor(n * 0.4), 1)")
def hi_regressor(s, d):
    return rounded(health.hi_regressor(train(health_panel(s, d)), "hi"))


@query(f"with {_OBS} select entity_id, n, round(last, 6) as last, round(ext_long, 5) as rul_linear, true_rul from obs")
def linear_extrapolation(s, d):
    return crossing.linear_extrapolation(observed(s, d)).select("entity_id", "n", F.round("last", 6).alias("last"), F.round("rul_linear", 5).alias("rul_linear"), "true_rul")


@query(f"with {_PATH}, c as (select entity_id, min(case when mean >= threshold then i end) as c from path join (select entity_id, threshold from obs) using (entity_id) group by entity_id) select entity_id, cast(case when c is not null then greatest(c, 3) end as int) as crossing from c")
def first_crossing(s, d):
    obs = observed(s, d)
    return crossing.first_crossing(crossing.linear_paths(obs), obs).select("entity_id", F.col("crossing").cast("int").alias("crossing"))


def _rul(value: str, name: str) -> str:
    return f"""{name} as (select o.entity_id, o.n, o.last, o.true_rul, o.ext_long, case when o.last >= o.threshold then ext_short when c is not null then greatest(c, 3)
        when f30 > 1e-4 and 30 + (o.threshold - v29) / f30 <= 200 then least(greatest(30 + (o.threshold - v29) / f30, 0), 125) else ext_long end as rul
        from obs o join (select entity_id, min(case when {value} >= threshold then i end) as c, regr_slope(case when i < 30 then {value} end, i) as f30, max(case when i = 29 then {value} end) as v29
        from path join (select entity_id, threshold from obs) using (entity_id) group by entity_id) using (entity_id))"""


@query(f"with {_PATH}, {_rul('mean', 'a')} select entity_id, round(rul, 5) as rul_pred from a")
def rul_from_forecast(s, d):
    obs = observed(s, d)
    return crossing.rul_from_forecast(crossing.linear_paths(obs), obs).select("entity_id", F.round("rul_pred", 5).alias("rul_pred"))


_SHARE = _PATH.replace("greatest(least(floor(n / 4), 15), 5)", "greatest(floor(n * 0.2), 1)")


@query(f"with {_SHARE}, {_rul('mean', 'a')} select entity_id, round(rul, 5) as rul_pred from a")
def alternative_crossing(s, d):
    """The short tail is a share of the history, and flat histories give the cap, whatever the fallback is."""
    t = health.failure_threshold(train(health_panel(s, d)), 0.05, index="hi")
    obs = crossing.with_parameters(crossing.observed(cut_panel(s, d), "hi", short_share=True), t, None, P.cap).withColumn("fallback", F.lit(60.0))
    return rounded(crossing.rul_from_forecast(crossing.linear_paths(obs), obs, plain=True).select("entity_id", "rul_pred"), 5)


@query(f"with {_OBS} select entity_id, round(case when entity_id % 3 = 0 then ext_long else 50.0 end, 5) as rul_pred, case when entity_id % 3 = 0 then 0.0 else 40.0 end as lower_bound, case when entity_id % 3 = 0 then 125.0 else 60.0 end as upper_bound from obs")
def fallback_rows(s, d):
    """A predictor that gives two of three entities a value; the others get their linear estimate and the whole range."""
    obs = crossing.linear_extrapolation(observed(s, d))
    some = obs.where("entity_id % 3 <> 0").select("entity_id", *[F.lit(v).alias(n) for n, v in (("rul_pred", 50.0), ("lower_bound", 40.0), ("upper_bound", 60.0))])
    return rounded(crossing.with_fallback(obs, some).select("entity_id", "rul_pred", "lower_bound", "upper_bound"), 5)


_BANDS = f"{_PATH}, {_rul('mean', 'a')}, {_rul('hi', 'b')}, {_rul('lo', 'c')}, z as (select a.entity_id, a.ext_long, least(a.rul, 125) as x, least(b.rul, 125) as y, least(c.rul, 125) as w from a join b using (entity_id) join c using (entity_id)), f as (select entity_id, ext_long, x as p, least(x, y, w) as lo, greatest(x, y, w) as up from z)"


@query(f"with {_BANDS} select entity_id, round(p, 5) as rul_pred, round(lo, 5) as lower_bound, round(up, 5) as upper_bound from f")
def bounds_from_bands(s, d):
    obs = observed(s, d)
    return rounded(crossing.bounds_from_bands(crossing.linear_paths(obs), obs).select("entity_id", "rul_pred", "lower_bound", "upper_bound"), 5)


@query(f"with {_BANDS} select entity_id, round(least(p, greatest(1.5 * ext_long, 5)), 5) as rul_pred, round(least(lo, greatest(1.5 * ext_long, 5)), 5) as lower_bound from f")
def velocity_ceiling(s, d):
    obs = crossing.linear_extrapolation(observed(s, d))
    return rounded(crossing.velocity_ceiling(crossing.bounds_from_bands(crossing.linear_paths(obs), obs)).select("entity_id", "rul_pred", "lower_bound"), 5)


@query(f"with {_OBS} select entity_id, true_rul, round(ext_long * 0.88, 5) as rul_pred, round(least(ext_long * 0.8, ext_long * 0.88), 5) as lower_bound, round(greatest(least(ext_long * 1.2, 125), ext_long * 0.88), 5) as upper_bound from obs")
def predict_fleet(s, d):
    t = health.failure_threshold(train(health_panel(s, d)), 0.05, index="hi")
    return rounded(crossing.predict_fleet(cut_panel(s, d), t, None, 0.88, "hi"), 5)


@query()
def predict_fleet_by_forecast(s, d):
    t = health.failure_threshold(train(health_panel(s, d)), 0.05, index="hi")
    return rounded(crossing.predict_fleet(cut_panel(s, d), t, None, 0.88, "hi", predictor=crossing.forecast_predictor(index="hi")), 5)


@query(f"with {_PATH}, {_rul('mean', 'a')}, l as (select entity_id, rul as v from a union all select entity_id, ext_long from obs union all select entity_id, ext_short from obs) select entity_id, round(quantile_cont(v, 0.5), 5) as rul_pred from l group by 1")
def ensemble_median(s, d):
    obs = observed(s, d)
    three = [crossing.rul_from_forecast(crossing.linear_paths(obs), obs), *[obs.withColumn("rul_pred", crossing.extrapolate(F.col(c), F.col("threshold"), P.cap, F.col("fallback"))) for c in ("slope_long", "slope_short")]]
    long = reduce(DataFrame.unionByName, [x.select("entity_id", "rul_pred") for x in three])
    return rounded(crossing.ensemble_median(long, obs.select("entity_id", "fallback")), 5)


@query(f"""with {_H}{_CUT}, th as (select unnest([0.01, 0.05, 0.1, 0.2, 0.3, 0.5]) as q, unnest(quantile_cont(hi, [0.01, 0.05, 0.1, 0.2, 0.3, 0.5])) as threshold from h where entity_id % 5 <> 0 and rul <= 5),
    o0 as (select *, row_number() over (partition by entity_id order by step desc) as k, count(*) over (partition by entity_id) as n from cut where entity_id % 5 <> 0),
    o1 as (select entity_id, max_by(hi, step) as last, regr_slope(case when k <= greatest(least(floor(n * 0.2), 30), 5) then hi end, step) as sl, cast(max_by(rul, step) as double) as true_rul from o0 group by entity_id),
    g as (select q, threshold, true_rul, case when coalesce(sl, 0) <= 1e-4 then 125.0 else least(greatest((threshold - last) / sl, 0), 125) end as rul_pred from o1 cross join th)
    select cast(q as double) as q, round(threshold, 4) as threshold, * exclude (q, threshold) from ({evaluated("g", "q, threshold", digits=3)})""")
def threshold_grid(s, d):
    g = crossing.threshold_grid(train(health_panel(s, d)), train(cut_panel(s, d)), index="hi")
    digits = {"q": 2, "threshold": 4}
    return g.select(*[F.round(c, digits.get(c, 3)).alias(c) if t == "double" else F.col(c) for c, t in g.dtypes])


@query(f"with {_T}, g as (select unnest([0.75, 0.8, 0.85, 0.88, 0.9, 0.95, 1.0]) as factor, * from one), x as (select cast(factor as double) as factor, true_rul, rul_pred * cast(factor as double) as rul_pred from g) {evaluated('x', 'factor')}")
def safety_factor_grid(s, d):
    return rounded(crossing.safety_factor_grid(panels.lifetime_predictions(panels.lineitem_panel(s, d))), 4)


@query(f"select * from ({ORACLE_SQL['threshold_grid']}) order by rmse, q limit 1")
def best_threshold(s, d):
    return metrics.best_of_grid(threshold_grid(s, d), "rmse", "q")


@query(f"select * from ({ORACLE_SQL['safety_factor_grid']}) order by rmse, factor limit 1")
def best_safety_factor(s, d):
    return metrics.best_of_grid(safety_factor_grid(s, d), "rmse", "factor")


@query(f"with {_E}, k as (select entity_id, step, s1 as actual, lag(s1) over w as predicted, row_number() over w as k, count(*) over (partition by entity_id) as n from lab window w as (partition by entity_id order by step)) select entity_id, step, round(actual, 6) as actual, round(predicted, 6) as predicted from k where n >= 20 and k > floor(n * 0.7)")
def persistence_walk_forward(s, d):
    return rounded(forecast.persistence_walk_forward(events(s, d), "s1", spec=P40))


@query(f"with {_E}, k as (select entity_id, s1 as actual, lag(s1) over w as predicted, row_number() over w as k, count(*) over (partition by entity_id) as n from lab window w as (partition by entity_id order by step)), e as (select entity_id, sqrt(avg(pow(actual - predicted, 2))) as rmse from k where n >= 20 and k > floor(n * 0.7) group by 1) select count(*) as entities, round(avg(rmse), 6) as mean, round(stddev_pop(rmse), 6) as sd, round(min(rmse), 6) as least, round(max(rmse), 6) as most from e")
def walk_forward_rmse(s, d):
    return rounded(forecast.walk_forward_rmse(forecast.persistence_walk_forward(events(s, d), "s1", spec=P40)))


# --- metrics and intervals ------------------------------------------------------------------------------------------


@query(f"with {_T} {evaluated('t', 'model_name')}")
def evaluate_models(s, d):
    return rounded(metrics.evaluate(predictions(s, d)), 4)


_BAD = "x as (select model_name, case when entity_id % 10 = 0 then rul_pred - 200 when entity_id % 15 = 0 then rul_pred + 200 else rul_pred end as rul_pred, case when entity_id % 20 = 0 then upper_bound + 1 else lower_bound end as lower_bound, upper_bound, true_rul, entity_id from t)"


def spoiled(s, d):
    e = F.col("entity_id")
    return predictions(s, d).withColumns({"rul_pred": F.when(e % 10 == 0, F.col("rul_pred") - 200).when(e % 15 == 0, F.col("rul_pred") + 200).otherwise(F.col("rul_pred")), "lower_bound": F.when(e % 20 == 0, F.col("upper_bound") + 1).otherwise(F.col("lower_bound"))})


@query(f"with {_T}, {_BAD} select model_name, count_if(rul_pred < 0) as negative, count_if(rul_pred > 125) as over_cap, count_if(lower_bound > upper_bound) as inverted, count_if(rul_pred < lower_bound - 1e-6 or rul_pred > upper_bound + 1e-6) as outside, cast(0 as bigint) as not_finite from x group by 1")
def validate_predictions(s, d):
    return intervals.validate_predictions(spoiled(s, d))


@query(f"with {_T}, {_BAD}, y as (select *, least(greatest(rul_pred, 0), 125) as p, least(greatest(lower_bound, 0), 125) as a, least(greatest(upper_bound, 0), 125) as b from x) select entity_id, model_name, round(p, 6) as rul_pred, round(least(a, b, p), 6) as lower_bound, round(greatest(a, b, p), 6) as upper_bound from y")
def repair_bounds(s, d):
    return rounded(intervals.repair_bounds(spoiled(s, d)).select("entity_id", "model_name", "rul_pred", "lower_bound", "upper_bound"))


@query(f"with {_T} select model_name, round(avg(cast(true_rul between lower_bound and upper_bound as int)) * 100, 6) as coverage, round(avg(upper_bound - lower_bound), 6) as width from t group by 1")
def coverage_width(s, d):
    return rounded(intervals.coverage_width(predictions(s, d)))


_Q = "l as (select model_name, true_rul, cast(0.1 as double) as q, lower_bound as pred from t union all select model_name, true_rul, 0.5, rul_pred from t union all select model_name, true_rul, 0.9, upper_bound from t)"


@query(f"with {_T}, {_Q} select model_name, q, round(avg(greatest(q * (true_rul - pred), (q - 1) * (true_rul - pred))), 6) as pinball from l group by 1, 2")
def pinball_by_quantile(s, d):
    return rounded(intervals.pinball_by_quantile(intervals.quantile_rows(predictions(s, d))))


@query(f"with {_T}, {_Q}, r as (select model_name, q, avg(cast(true_rul <= pred as int)) as observed from l group by 1, 2) select model_name, q, round(observed, 6) as observed, round(avg(abs(observed - q)) over (partition by model_name), 6) as mce from r")
def reliability_table(s, d):
    return rounded(intervals.reliability_table(intervals.quantile_rows(predictions(s, d))))


@query(f"""with {_T}, bk as (select *, case when true_rul >= 0 and true_rul < 25 then '0-25' when true_rul < 50 then '25-50' when true_rul < 100 then '50-100' when true_rul <= 125 then '100-125' end as bucket from t)
    select model_name, bucket, count(*) as n, round(avg(cast(true_rul between lower_bound and upper_bound as int)) * 100, 6) as coverage, round(avg(upper_bound - lower_bound), 6) as mean_width, round(quantile_cont(upper_bound - lower_bound, 0.5), 6) as median_width from bk group by 1, 2""")
def coverage_by_bucket(s, d):
    return rounded(intervals.coverage_by_bucket(predictions(s, d)))


@query(f"with {_L}, mm as (select avg(rul) as mv from lab where entity_id % 5 <> 0), {_T[len(_P) + 2:]}, g as (select 'train_mean' as model_name, true_rul, mv as rul_pred from one cross join mm union all select 'half_cap', true_rul, 62.5 from one) {evaluated('g', 'model_name')}")
def naive_baselines(s, d):
    p = lines(s, d)
    return rounded(metrics.evaluate(metrics.naive_baselines(panels.lifetime_predictions(p), train(p).agg(F.avg("rul").alias("m")))), 4)


def halves(s, d):
    t = predictions(s, d)
    side = F.expr("(entity_id div 5) % 2")
    return t.where(side == 0), t.where(side == 1)


_DELTA = """s as (select model_name, greatest(lower_bound - true_rul, true_rul - upper_bound, 0) as score from t where (entity_id // 5) % 2 = 0),
    r as (select *, row_number() over (partition by model_name order by score) as k, count(*) over (partition by model_name) as n from s),
    lv as (select *, least(ceil((n + 1) * target) / n, 1.0) * (n - 1) as pos from (select r.*, cast(tg as double) as target from r cross join (select unnest([0.8, 0.9]) as tg))),
    dl as (select model_name, target, sum(case when k - 1 = floor(pos) then score * (1 - (pos - floor(pos))) when k - 1 = floor(pos) + 1 then score * (pos - floor(pos)) else 0 end) as delta from lv group by 1, 2)"""


@query(f"with {_T}, {_DELTA} select model_name, target, round(delta, 6) as delta from dl")
def conformal_margin(s, d):
    return rounded(intervals.conformal_margin(halves(s, d)[0], (0.8, 0.9)))


_AFTER = "af as (select t.*, target, delta, least(greatest(lower_bound - delta, 0), 125) as lo, least(greatest(upper_bound + delta, 0), 125) as up from t join dl using (model_name) where (entity_id // 5) % 2 = 1)"


@query(f"with {_T}, {_DELTA}, {_AFTER} select entity_id, model_name, target, round(lo, 6) as lower_bound, round(up, 6) as upper_bound from af")
def conformal_apply(s, d):
    a, b = halves(s, d)
    return rounded(intervals.apply_margin(b, intervals.conformal_margin(a, (0.8, 0.9))).select("entity_id", "model_name", "target", "lower_bound", "upper_bound"))


@query(f"""with {_T}, {_DELTA}, {_AFTER} select model_name, target, round(delta, 6) as delta, round(avg(cast(true_rul between lo and up as int)) * 100, 6) as after, round(avg(up - lo), 6) as width,
    round(avg(cast(true_rul between lower_bound and upper_bound as int)) * 100, 6) as before, case when avg(cast(true_rul between lo and up as int)) * 100 >= 79.5 then 'ok' else 'low' end as status from af group by model_name, target, delta""")
def calibration_report(s, d):
    return rounded(intervals.calibration_report(*halves(s, d)))


@query(f"with {_T}, e as ({evaluated('t', 'model_name')}) select model_name, rmse, cast(row_number() over (order by rmse, model_name) as int) as rank from e")
def rank_models(s, d):
    return metrics.rank_models(rounded(metrics.evaluate(predictions(s, d)), 4)).select("model_name", "rmse", "rank")


def result_log(s, d):
    """Two runs of both models; the later ones without intervals."""
    m = metrics.evaluate(predictions(s, d)).select("model_name", "rmse").join(intervals.coverage_width(predictions(s, d)), "model_name")
    late = m.select("model_name", (F.col("rmse") + F.when(F.col("model_name") == "half_cap", 0.5).otherwise(-0.5)).alias("rmse"), F.lit(None).cast("double").alias("coverage"), F.lit(None).cast("double").alias("width"), F.lit("2024-01-02 00:00:00").alias("timestamp"))
    return m.withColumn("timestamp", F.lit("2024-01-01 00:00:00")).unionByName(late)


_LOG = f"e as ({evaluated('t', 'model_name', digits=12)}), mm as (select model_name, rmse, avg(cast(true_rul between lower_bound and upper_bound as int)) * 100 as coverage, avg(upper_bound - lower_bound) as width from t join (select model_name, rmse from e) using (model_name) group by 1, 2)"


@query(f"with {_T}, {_LOG} select model_name, '2024-01-02 00:00:00' as timestamp, round(rmse + case when model_name = 'half_cap' then 0.5 else -0.5 end, 6) as rmse, round(coverage, 6) as coverage, round(width, 6) as width, cast(row_number() over (order by rmse + case when model_name = 'half_cap' then 0.5 else -0.5 end, model_name) as int) as rank from mm")
def latest_results(s, d):
    return rounded(tables.latest_results(result_log(s, d)))


@query(f"with {_T}, {_LOG} select 'plain' as family, min_by(model_name, rmse) as best_model, round(min(rmse), 6) as rmse, round(avg(coverage), 6) as coverage, round(avg(width), 6) as width from mm")
def family_summary(s, d):
    m = metrics.evaluate(predictions(s, d)).select("model_name", "rmse").join(intervals.coverage_width(predictions(s, d)), "model_name")
    return rounded(metrics.family_summary(m.withColumn("family", F.lit("plain"))))


@query(f"with {_T} select entity_id, model_name, lower_bound, case when lower_bound <= 15 then 'immediate' when lower_bound <= 40 then 'plan' else 'monitor' end as zone from t")
def maintenance_zones(s, d):
    return predictions(s, d).select("entity_id", "model_name", "lower_bound", S.maintenance_zone(F.col("lower_bound")).alias("zone"))


@query(f"with {_L} select cast(least(floor(rul / (125.0 / 20)) + 1, 20) as int) as bin, count(*) as n from lab group by 1")
def histogram_table(s, d):
    return quality.histogram(lines(s, d), "rul", 0, 125, 20)


@query(f"with {_T} select model_name, count(*) as n, round(avg(true_rul), 6) as mean, round(stddev_pop(true_rul), 6) as sd, min(true_rul) as least, max(true_rul) as most from t group by 1")
def dataset_summary(s, d):
    return rounded(quality.dataset_summary(predictions(s, d), "model_name", "true_rul"))


@query(f"with {_T} select entity_id, model_name as model, true_rul as t, rul_pred, lower_bound as lo, upper_bound as hi from t where model_name = 'lifetime_table' and entity_id % 20 <> 0")
def calibration_input(s, d):
    holes = predictions(s, d).withColumn("lower_bound", F.when(F.col("entity_id") % 20 != 0, F.col("lower_bound")))
    return tables.load_for_calibration(holes, ["lifetime_table", "absent"])


@query(f"with {_T}, c as (select cast(cap as int) as cap, least(true_rul, cap) as true_rul, least(rul_pred, cap) as rul_pred from one cross join (select unnest([100, 110, 115, 120, 125, 130, 140, 150]) as cap)) {evaluated('c', 'cap')}")
def cap_grid(s, d):
    return rounded(metrics.cap_grid(panels.lifetime_predictions(panels.lineitem_panel(s, d))), 4)


@query(f"with {_E}, l as (select entity_id, max(step) as lifetime from p group by 1), c as (select lifetime, count(*) as n from l group by 1) select cast(lifetime as int) as lifetime, n from c order by n desc, lifetime limit 1")
def modal_value(s, d):
    return metrics.modal_value(quality.lifetimes(panels.events_panel(s, d)), "lifetime")


@query(f"""with {_OBS}, f0 as (select *, row_number() over (partition by entity_id order by step desc) as k, count(*) over (partition by entity_id) as n from h),
    f1 as (select entity_id, count(*) as n, max_by(hi, step) as last, regr_slope(case when k <= greatest(least(floor(n * 0.2), 30), 5) then hi end, step) as sl from f0 group by entity_id),
    f2 as (select entity_id, n, last, case when coalesce(sl, 0) <= 1e-4 then 125.0 else least(greatest((threshold - last) / sl, 0), 125) end as r from f1 cross join th)
    select entity_id, n, round(last, 6) as last, round(r, 6) as rul_pred, case when r <= 15 then 'immediate' when r <= 40 then 'plan' else 'monitor' end as zone from f2""")
def flagship(s, d):
    return fleet.maintenance_plan(health_panel(s, d), ~panels.is_test())


# --- learned operators and grouped maps: rows only -------------------------------------------------------------------


@query()
def fit_regimes(s, d):
    model = regimes.fit_regimes(train(panels.lineitem_panel(s, d)))
    return regimes.cluster_sizes(regimes.assign_regimes(panels.lineitem_panel(s, d), [list(map(float, c)) for c in model.clusterCenters()]), "op_cluster")


@query()
def choose_k(s, d):
    return regimes.choose_k(panels.lineitem_panel(s, d))


@query()
def fit_health_index(s, d):
    p = lines(s, d)
    return health.apply_health_index(test(p), health.fit_health_index(train(p), threshold=0.0)).select("entity_id", "step", "health_index")


@query()
def pca_diagnostics(s, d):
    return health.pca_diagnostics(train(lines(s, d)))


@query()
def threshold_sensitivity(s, d):
    return health.threshold_sensitivity(train(lines(s, d)))


@query()
def isotonic_index(s, d):
    return health.isotonic_index(health_panel(s, d), "hi")


@query(f"""with recursive {_E}, {_ACF}, l as (select entity_id, list(acf order by lag) as r from acf group by entity_id having count(acf) = count(*)),
    dl as (select entity_id, r, 0 as k, []::double[] as phi, 1.0::double as v, null::double as a from l
        union all
        select entity_id, r, k + 1, list_concat([phi[i] - na * phi[k + 1 - i] for i in range(1, k + 1)], [na]), v * (1 - na * na), na
        from (select *, case when v > 1e-12 then (r[k + 2] - coalesce(list_sum([phi[i] * r[k + 2 - i] for i in range(1, k + 1)]), 0)) / v else 0 end as na from dl where k + 2 <= len(r)))
    select entity_id, k as lag, round(a, 6) as pacf from dl where k > 0""")
def pacf_table(s, d):
    return rounded(windows.pacf_table(windows.acf_table(events(s, d), "s1", 10, P40)))


@query()
def adf_by_entity(s, d):
    return forecast.adf_by_entity(events(s, d), "s1", P40)


@query()
def d_distribution(s, d):
    return forecast.d_distribution(adf_by_entity(s, d))


#: Fits told by the entity and the order, to hold what is chosen from fits against SQL.
_FITS = f"{_P}, ids as (select distinct entity_id from p), g as (select entity_id, p, d, q, case when (entity_id + p) % 7 <> 0 then ((entity_id % 13) * 31 + p * 57 + d * 11 + q * 23) % 101 * 1.0 end as aic from ids, unnest([1, 2, 3]) as a(p), unnest([0, 1]) as b(d), unnest([0, 1, 2]) as c(q))"


def told_fits(s, d):
    ids = panels.lineitem_panel(s, d).select("entity_id").distinct()
    rows = ids.select("entity_id", *[F.explode(F.array(*map(F.lit, v))).alias(n) for n, v in [("p", (1, 2, 3))]])
    for n, v in (("d", (0, 1)), ("q", (0, 1, 2))):
        rows = rows.withColumn(n, F.explode(F.array(*map(F.lit, v))))
    aic = ((F.col("entity_id") % 13) * 31 + F.col("p") * 57 + F.col("d") * 11 + F.col("q") * 23) % 101
    return rows.withColumn("aic", F.when((F.col("entity_id") + F.col("p")) % 7 != 0, aic.cast("double")))


_BEST = f"{_FITS}, r as (select *, row_number() over (partition by entity_id order by aic, p, d, q) as k from g where aic is not null), best as (select entity_id, p, d, q from r where k = 1)"


@query(f"with {_BEST} select entity_id, p, d, q from best")
def best_orders_of_fits(s, d):
    return forecast.best_orders(told_fits(s, d))


@query(f"with {_BEST} select p, d, q, count(*) as n from best group by p, d, q order by n desc, p, d, q limit 1")
def modal_order_of_fits(s, d):
    return forecast.modal_order(told_fits(s, d))


@query(f"with {_P}, a as (select entity_id, case when max(step) % 4 < 3 then cast(max(step) % 4 as int) end as d from p group by entity_id) select d, count(*) as n from a where d is not null group by d")
def d_distribution_of_fits(s, d):
    d_of = F.col("lifetime") % 4
    tests = quality.lifetimes(panels.lineitem_panel(s, d)).select("entity_id", F.when(d_of < 3, d_of).alias("d"), F.when(d_of < 3, "ok").otherwise("short").alias("status"))
    return forecast.d_distribution(tests)


@query()
def order_grid(s, d):
    return forecast.order_grid(events(s, d), "s1", spec=P40)


@query()
def modal_order(s, d):
    return forecast.modal_order(forecast.order_grid(events(s, d), "s1", spec=P40))


@query()
def forecast_by_entity(s, d):
    return forecast.forecast_by_entity(events(s, d), "s1", (1, 1, 0), spec=P40)


@query()
def walk_forward(s, d):
    return forecast.walk_forward(events(s, d), "s1", (1, 0, 0), spec=P40)


#: 95 % points of the chi-squared distribution with 1 to 20 degrees of freedom.
_CHI2_95 = [3.841459, 5.991465, 7.814728, 9.487729, 11.070498, 12.591587, 14.067140, 15.507313, 16.918978, 18.307038]
_CHI2_95 += [19.675138, 21.026070, 22.362032, 23.684791, 24.995790, 26.296228, 27.587112, 28.869299, 30.143527, 31.410433]


@query(f"""with {_E}, {_ACF.replace("between 0 and 10", "between 0 and 20")},
    q as (select a.entity_id, a.lag, a.n * (a.n + 2) * sum(b.acf * b.acf / (b.n - b.lag)) as q from acf a join acf b on a.entity_id = b.entity_id and b.lag between 1 and a.lag where a.lag > 0 group by a.entity_id, a.lag, a.n),
    v as (select entity_id, min(case when q >= ({_CHI2_95})[lag] then lag end) as bad from q group by entity_id)
    select entity_id, case when bad is null then 'white noise' when bad > 10 then 'late' else 'early' end as verdict from v""")
def ljung_box(s, d):
    return forecast.ljung_box_verdict(forecast.ljung_box(events(s, d), "s1", 20, P40))


_NORMAL = ", ".join(repr(NormalDist().inv_cdf((k + 1) / 20)) for k in range(19))
_LEVELS = ", ".join(repr((k + 1) / 20) for k in range(19))


@query(f"""with {_E}, r as (select s1 - lag(s1) over (partition by entity_id order by step) as x, step from lab),
    v as (select avg(x) as mean, stddev_samp(x) as sd, quantile_cont(x, [{_LEVELS}]) as q from r where step > 1)
    select round(mean, 6) as mean, round(sd, 6) as sd, round(unnest([{_NORMAL}]::double[]), 6) as normal, round(unnest(q), 6) as observed from v""")
def residual_profile(s, d):
    e = windows.difference(events(s, d), "s1", 1, P40)
    return rounded(forecast.residual_profile(e, "diff"))


def _sides(s, d):
    e = events(s, d)
    return train(e), test(label.truncate_histories(e, spec=P40).drop("rul_last"))


@query()
def fit_point_regressor(s, d):
    a, b = _sides(s, d)
    model = learn.fit_point_regressor("linear", windows.window_arrays(a, P40.sensors, 30, spec=P40))
    return learn.score_windows(model, windows.window_arrays(b, P40.sensors, 30, True, P40), "linear", 40)


@query()
def fit_asymmetric_regressor(s, d):
    a, b = (windows.window_arrays(x, P40.sensors, 30, k == 1, P40) for k, x in enumerate(_sides(s, d)))
    model, _ = learn.fit_boosted(a, b, "asymmetric")
    return learn.score_boosted(model, b, cap=40).select("entity_id", "label", "rul_pred")


@query()
def fit_quantile_regressor(s, d):
    a, b = (windows.window_arrays(x, P40.sensors, 30, k == 1, P40) for k, x in enumerate(_sides(s, d)))
    return learn.score_quantiles(learn.fit_quantile_regressor(a, cap=40), b, 40)


@query()
def window_length_sensitivity(s, d):
    a, b = _sides(s, d)
    return learn.window_length_sensitivity(a, b, P40.sensors, spec=P40)


@query()
def input_importance(s, d):
    a, _ = _sides(s, d)
    model = learn.fit_point_regressor("forest", windows.window_arrays(a, P40.sensors, 30, spec=P40))
    return learn.input_importance(model, P40.sensors, 30)
