"""Scoring models: a linear one as plain columns, MLlib for training, save and load."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from holdfast.operators.prep import Preprocessor
from holdfast.schemas import FEATURES, LABEL

GAP = "avg_session_gap_days"
GAP_MISSING = "gap_missing"
TREE_FEATURES = FEATURES + (GAP_MISSING,)
MODEL_CLASS = "model_class"
TREE_LOG_ODDS = 2.0  # the boosted model's probability is 1 / (1 + exp(-2 * raw score))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


@dataclass(frozen=True)
class LinearModel:
    """Logistic model on scaled features, evaluated as a column expression."""

    intercept: float
    coefficients: dict[str, float]
    prefix: str = "scaled_"

    def margin(self) -> Column:
        total = F.lit(self.intercept)
        for feature, weight in self.coefficients.items():
            total = total + F.lit(weight) * F.col(self.prefix + feature)
        return total

    def score(self, scaled: DataFrame) -> DataFrame:
        """Adds margin (log-odds) and churn_probability."""
        return scaled.withColumn("margin", self.margin()).withColumn(
            "churn_probability", sigmoid(F.col("margin"))
        )


def train_lr(scaled_train: DataFrame, c: float = 1.0, max_iter: int = 1000) -> PipelineModel:
    """Logistic regression with an L2 penalty of strength 1/c on the summed loss."""
    n = scaled_train.count()
    inputs = [f"scaled_{f}" for f in FEATURES]
    stages = [
        VectorAssembler(inputCols=inputs, outputCol="features"),
        LogisticRegression(
            labelCol=LABEL, maxIter=max_iter, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False
        ),
    ]
    return Pipeline(stages=stages).fit(scaled_train)


def as_linear(model: PipelineModel) -> LinearModel:
    """Coefficients of a trained logistic regression."""
    fitted = model.stages[-1]
    weights = dict(zip(FEATURES, (float(w) for w in fitted.coefficients)))
    return LinearModel(float(fitted.intercept), weights)


def tree_input(encoded: DataFrame, prep: Preprocessor) -> DataFrame:
    """Unscaled input for the trees: a missing gap is flagged in its own column and filled."""
    flagged = encoded.withColumn(GAP_MISSING, F.col(GAP).isNull().cast("int"))
    return prep.impute(flagged)


def restore_gap(df: DataFrame) -> DataFrame:
    """Puts the NULL back where `tree_input` filled the gap, for display."""
    return df.withColumn(GAP, F.when(F.col(GAP_MISSING) == 0, F.col(GAP)))


def train_gbt(tree_train: DataFrame, trees: int = 100, depth: int = 4, step: float = 0.1, seed: int = 42) -> PipelineModel:
    stages = [
        VectorAssembler(inputCols=list(TREE_FEATURES), outputCol="features"),
        GBTClassifier(labelCol=LABEL, maxIter=trees, maxDepth=depth, stepSize=step, seed=seed),
    ]
    return Pipeline(stages=stages).fit(tree_train)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds churn_probability (class 1), margin (log-odds) and the class the model itself names; drops its other columns."""
    scale = TREE_LOG_ODDS if isinstance(model.stages[-1], GBTClassificationModel) else 1.0
    return model.transform(df).withColumns({
        "churn_probability": vector_to_array("probability")[1],
        "margin": vector_to_array("rawPrediction")[1] * scale,
        MODEL_CLASS: F.col("prediction").cast("int"),
    }).drop("features", "rawPrediction", "probability", "prediction")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
