"""Training, scoring and evaluation of models; the search over parameters is MLlib's."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from .dataset import apply_scaler, with_class_weight
from .forest import Forest, grow_forest
from .metrics import auc, binary_metrics
from .prediction_log import feature_columns, split_valid
from .sizing import join_small

_VECTOR = "_features"


def _stages(features: Sequence[str], label: str, settings: Settings):
    assembler = VectorAssembler(inputCols=list(features), outputCol=_VECTOR)
    forest = RandomForestClassifier(
        featuresCol=_VECTOR,
        labelCol=label,
        weightCol="weight",
        numTrees=settings.num_trees,
        maxDepth=settings.max_depth,
        # the nearest to a minimum split size: no leaf below half of it
        minInstancesPerNode=max(1, settings.min_samples_split // 2),
        seed=settings.seed,
    )
    return assembler, forest


def train_forest(df: DataFrame, features: Sequence[str], label: str, settings: Settings | None = None) -> Forest:
    """Random forest with balanced class weights and a minimum size for a split."""
    return grow_forest(df, features, label, settings)


def search_forest(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    grid: Mapping[str, Sequence[object]],
    folds: int = 3,
    parallelism: int = 2,
    settings: Settings | None = None,
) -> CrossValidatorModel:
    """Cross-validated search over the parameters of MLlib's forest (``{"maxDepth": [5, 10]}``)."""
    assembler, forest = _stages(features, label, settings or Settings())
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(forest, name), list(values))
    search = CrossValidator(
        estimator=Pipeline(stages=[assembler, forest]),
        estimatorParamMaps=builder.build(),
        evaluator=BinaryClassificationEvaluator(labelCol=label),
        numFolds=folds,
        parallelism=parallelism,
        seed=(settings or Settings()).seed,
    )
    return search.fit(with_class_weight(df, label))


def score(model: Forest | PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``predicted_label`` and ``confidence`` (probability of class 1)."""
    if isinstance(model, Forest):
        return model.score(df)
    scored = model.transform(df)
    return scored.withColumn("predicted_label", F.col("prediction").cast("int")).withColumn(
        "confidence", vector_to_array("probability")[1]
    ).drop(_VECTOR, "rawPrediction", "probability", "prediction")


def score_transactions(
    model: Forest | PipelineModel,
    transactions: DataFrame,
    features: Sequence[str],
    scaler: DataFrame | None = None,
    scaled_column: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Score rows with a feature map: (scored, quarantined for missing names)."""
    valid, rejected = split_valid(transactions, features)
    wide = feature_columns(valid, features)
    if scaler is not None and scaled_column is not None:
        wide = apply_scaler(wide, scaler, scaled_column)
    return score(model, wide).select(*transactions.columns, "predicted_label", "confidence"), rejected


def evaluate(scored: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, the four metrics and ``auc_roc`` of a scored frame."""
    base = binary_metrics(scored, label, "predicted_label", by)
    area = auc(scored, label, "confidence", by).withColumnRenamed("auc", "auc_roc")
    if by:
        return base.join(area, list(by), "left")
    return join_small(base, area, [])


def feature_importance(model: Forest | PipelineModel, features: Sequence[str]) -> DataFrame:
    """(feature, importance), a row per feature."""
    if isinstance(model, Forest):
        return model.importance()
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")
