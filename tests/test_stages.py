"""Regressors as ML stages: every registered model in pipelines, tuned, saved and loaded."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import functions as F

from panelspark.operators import learn, metrics


@pytest.fixture(scope="module")
def windows(spark):
    """Labels that fall with the first value, by steps; the second value is noise. Two of three entities are for fitting."""
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (240, 2))
    rows = [(int(k), [float(a), float(b)], float(100 - 60 * (a > 0.5) - 20 * a), bool(k % 3 == 0)) for k, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "entity_id int, features array<double>, label double, held boolean").cache()


def error(model, df):
    return model.transform(df).agg(F.sqrt(F.avg((F.col("label") - F.col("rul_pred")) ** 2))).first()[0]


@pytest.mark.parametrize("name", [*learn.REGISTRY, *learn.BOOSTED])
def test_every_model_learns_and_survives_saving(spark, windows, tmp_path, name):
    fit, held = windows.where("not held"), windows.where("held")
    spread = held.agg(F.stddev_pop("label")).first()[0]
    params = {"maxIter": 6} if name in learn.BOOSTED else {"maxIter": 60} if name == "factorised" else {}
    model = learn.RulEstimator(name, cap=90, **params).fit(fit)
    out = model.transform(held)
    assert out.columns == [*held.columns, "rul_pred"] and out.where("rul_pred < 0 or rul_pred > 90").isEmpty()
    assert error(model, held) < (1.05 if name == "factorised" else 0.8) * spread
    model.write().save(f"{tmp_path}/m")
    back = learn.RulModel.load(f"{tmp_path}/m")
    assert back.uid == model.uid and back.getOrDefault("modelName") == name and back.getOrDefault("cap") == 90
    key = lambda df: sorted((r.entity_id, round(r.rul_pred, 9)) for r in df.collect())
    assert key(back.transform(held)) == key(out)
    first = held.orderBy("entity_id").first()
    assert abs(model.predict_single(first.features) - key(out)[0][1]) < 1e-6


@pytest.mark.parametrize("name", ["forest", "boosted_asymmetric"])
def test_in_a_pipeline(spark, windows, tmp_path, name):
    stages = [SQLTransformer(statement="select *, transform(features, x -> x * 2) as doubled from __THIS__"), learn.RulEstimator(name, maxIter=3, featuresCol="doubled", predictionCol="left", validationCol="held")]
    pipeline = Pipeline(stages=stages)
    pipeline.write().overwrite().save(f"{tmp_path}/p")
    model = Pipeline.load(f"{tmp_path}/p").fit(windows)
    model.write().overwrite().save(f"{tmp_path}/pm")
    back = PipelineModel.load(f"{tmp_path}/pm")
    got = [sorted((r.entity_id, round(r.left, 9)) for r in m.transform(windows).collect()) for m in (model, back)]
    assert got[0] == got[1] and len(got[0]) == 240


def test_tuned_by_cross_validation(windows, tmp_path):
    """Folds keep entities whole; the deeper forest is better, as labels fall by a step and a slope."""
    est = learn.RulEstimator("forest", numTrees=5)
    grid = ParamGridBuilder().addGrid(est.maxDepth, [1, 4]).build()
    folds = windows.withColumn("fold", F.pmod(F.xxhash64("entity_id"), F.lit(3)).cast("int"))
    judge = RegressionEvaluator(predictionCol="rul_pred", labelCol="label", metricName="rmse")
    model = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=judge, numFolds=3, foldCol="fold").fit(folds)
    assert model.avgMetrics[1] < model.avgMetrics[0] and model.bestModel.getOrDefault("maxDepth") == 4
    model.write().overwrite().save(f"{tmp_path}/cv")
    assert CrossValidatorModel.load(f"{tmp_path}/cv").bestModel.getOrDefault("modelName") == "forest"


def test_improvement():
    assert metrics.improvement(14.42, 30.33) == pytest.approx(52.456, abs=1e-3)
    assert metrics.improvement(20.0, 10.0) == -100.0
