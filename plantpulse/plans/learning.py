"""Failure classifier on the feature store."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.sources.shared import materialise

FEATURES = ("avg_temp_last_24h", "vibration_stddev_7d", "pressure_trend_7d", "cycles_since_last_pm",
            "days_since_last_failure", "oem_failure_rate_est", "downtime_impact_risk")


def train_and_score(features: DataFrame, split_sk: int, iterations: int = 20) -> tuple[DataFrame, float]:
    """Fit on days before ``split_sk``, score the rest; returns scores and the area under the ROC curve.

    The features are written once first: the optimiser passes over them many times.
    """
    rows = materialise(features.select(
        "asset_id", "observation_date_sk", *[F.col(c).cast("double").alias(c) for c in FEATURES],
        F.col("failed_in_next_7_days").cast("double").alias("label")), "features")
    past, later = rows.filter(F.col("observation_date_sk") < split_sk), rows.filter(F.col("observation_date_sk") >= split_sk)
    filled = [f"{c}_filled" for c in FEATURES]
    model = Pipeline(stages=[
        Imputer(strategy="mean", inputCols=list(FEATURES), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features"),
        LogisticRegression(maxIter=iterations, regParam=0.01),
    ]).fit(past)
    scored = model.transform(later)
    auc = BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(scored)
    out = scored.select("asset_id", "observation_date_sk", F.col("label").cast("boolean").alias("failed_in_next_7_days"),
                        vector_to_array("probability")[1].alias("failure_score"))
    return out, auc


def score_facts(scores: DataFrame) -> DataFrame:
    """What must hold of scores: rows by label, and whether all scores are chances."""
    return scores.groupBy("failed_in_next_7_days").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("failure_score").between(0, 1)).alias("scores_are_chances"))


def failure_scores(features: DataFrame, split_sk: int) -> DataFrame:
    """Scores per asset-day with the evaluation beside them."""
    scores, auc = train_and_score(features, split_sk)
    return scores.withColumn("auc", F.lit(auc))
