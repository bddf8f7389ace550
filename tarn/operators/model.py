"""Training and applying the match model."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.evaluate import best_threshold, threshold_sweep
from tarn.operators.features import fill_missing


def train(pairs: DataFrame, features: list[str], iterations: int = 200, boosted: bool = False, trees: int = 300) -> PipelineModel:
    """Balanced logistic regression on standardised features (or boosted trees), on pairs with a 0/1 label.

    Class weights are n / (2 * class size), the penalty that of unit inverse strength over the summed weights.
    """
    n, pos = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < pos < n:
        raise ValueError("training needs pairs of both labels")
    weighted = fill_missing(pairs, features).withColumn("weight", F.when(F.col("label") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))))
    assemble = VectorAssembler(inputCols=features, outputCol="raw")
    if boosted:
        return Pipeline(stages=[assemble, GBTClassifier(featuresCol="raw", labelCol="label", weightCol="weight", maxIter=trees, stepSize=0.05, maxDepth=6, seed=42)]).fit(weighted)
    scale = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)
    fit = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", maxIter=iterations, regParam=1.0 / n, elasticNetParam=0.0, standardization=False)
    return Pipeline(stages=[assemble, scale, fit]).fit(weighted)


def score(model: PipelineModel, pairs: DataFrame, features: list[str]) -> DataFrame:
    """pairs + prob of a match; features that pairs lack count as 0."""
    out = model.transform(fill_missing(pairs, features)).withColumn("prob", vector_to_array("probability")[1])
    return out.drop("raw", "scaled", "rawPrediction", "probability", "prediction")


def folded(model: PipelineModel, features: list[str]) -> tuple[dict[str, float], float]:
    """Coefficients and intercept over unscaled features, with the scaler folded in; for score bounds."""
    scaler, lr = model.stages[1], model.stages[2]
    c = [w / s if s else 0.0 for w, s in zip(lr.coefficients.toArray(), scaler.std.toArray())]
    return dict(zip(features, map(float, c))), float(lr.intercept - sum(w * m for w, m in zip(c, scaler.mean.toArray())))


def tune(scored: DataFrame, step: float = 0.02, low: float = 0.30, high: float = 0.91) -> float:
    """Threshold of the best pair-level F0.5, the least of equals."""
    grid = [round(low + i * step, 4) for i in range(int((high - low) / step) + 1) if low + i * step < high]
    return float(best_threshold(threshold_sweep(scored, grid)).first()["threshold"])


def save(model: PipelineModel, path: str, features: list[str], threshold: float, cap: int) -> None:
    """Model, and beside it what scoring must know: feature order, threshold, the candidate cap it was trained at."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps({"feats": features, "thr": threshold, "cap": cap}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def load(spark: SparkSession, path: str) -> dict:
    """{"model", "feats", "thr", "cap"}."""
    return {"model": PipelineModel.load(f"{path}/model")} | json.loads(spark.read.text(f"{path}/facts").first()[0])
