"""A conversion baseline on the features: train, score, and write one probability per user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import scalars as S


def train_baseline(train: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = None,
                   reg: float = 1e-4, max_iter: int = 50) -> PipelineModel:
    """Weighted logistic regression over scalar feature columns."""
    kw = {"weightCol": weight} if weight else {}
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep"),
        LogisticRegression(featuresCol="_features", labelCol=label, regParam=reg, maxIter=max_iter,
                           rawPredictionCol="_raw", probabilityCol="_prob", predictionCol="_pred", **kw),
    ]).fit(train)


def score(df: DataFrame, model: PipelineModel, label: str | None = "label") -> DataFrame:
    """Add logit and prob (and loss when the label is known)."""
    out = model.transform(df).withColumns({
        "logit": F.get(vector_to_array("_raw"), F.lit(1)), "prob": F.get(vector_to_array("_prob"), F.lit(1))})
    if label:
        out = out.withColumn("loss", S.bce_with_logits(F.col("logit"), F.col(label)))
    return out.drop("_features", "_raw", "_prob", "_pred")
