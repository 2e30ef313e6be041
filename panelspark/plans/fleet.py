"""Whole plans made of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.scalars import maintenance_zone
from panelspark.operators.crossing import linear_extrapolation, observed, with_parameters
from panelspark.operators.health import failure_threshold
from panelspark.operators.quality import dead_sensors
from panelspark.operators.regimes import apply_regime_scaler, assign_regimes, fit_regimes, regime_parameters
from panelspark.spec import PanelSpec

P = PanelSpec()


def scale_sensors(train: DataFrame, test: DataFrame, settings=("op1", "op2"), k: int = 6, spec: PanelSpec = P) -> tuple[DataFrame, DataFrame, dict, list[str]]:
    """H5: regimes fitted on train, sensors dead in some regime dropped, the others scaled by train parameters."""
    model = fit_regimes(train, k, settings)
    centres = [list(map(float, c)) for c in model.clusterCenters()]
    train, test = (assign_regimes(x, centres, settings, "op_cluster") for x in (train, test))
    by_cluster = PanelSpec(spec.entity, spec.step, spec.sensors, "op_cluster", spec.rul, spec.cap)
    dead = [r.sensor for r in dead_sensors(train, by_cluster).collect()]
    kept = [s for s in spec.sensors if s not in dead]
    parameters = regime_parameters(train, kept, "op_cluster")
    out = [apply_regime_scaler(x.drop(*dead), parameters, kept, "op_cluster") for x in (train, test)]
    return out[0], out[1], {"centres": centres, "parameters": parameters}, kept


def maintenance_plan(features: DataFrame, train: F.Column, index: str = "hi", spec: PanelSpec = P) -> DataFrame:
    """Threshold from train rows near their end, linear remaining life of every entity, and what to do."""
    threshold = failure_threshold(features.where(train), 0.05, index=index, spec=spec)
    obs = linear_extrapolation(with_parameters(observed(features, index, spec), threshold, None, spec.cap), spec)
    return obs.select(spec.entity, "n", F.round("last", 6).alias("last"), F.round("rul_linear", 6).alias("rul_pred"), maintenance_zone(F.col("rul_linear")).alias("zone"))
