"""Split, distributed model fit, scoring and model folders (ML1-ML5, P10-P12)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindsight.functions.columns import drop_columns, fill_missing, key_bucket, require_columns
from hindsight.operators.metrics import evaluate
from hindsight.session import shared_folder
from hindsight.sources.scan import scan, write_table
from hindsight.spec.model import RetrievalSpec

PREDICTION = "predict_is_fraud"


def split(df: DataFrame, key: str, held_out: int = 33) -> tuple[DataFrame, DataFrame]:
    """Training rows and the `held_out` percent of rows for testing, by a hash of the key
    (ML1): the same under any partitioning, and rows of one key stay together."""
    test = F.coalesce(key_bucket(key), F.lit(99)) < held_out
    return df.where(~test), df.where(test)


def split_at_random(df: DataFrame, held_out: float = 0.33, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Random split (ML1); repeatable only while the partitioning stays the same."""
    train_rows, test_rows = df.randomSplit([1 - held_out, held_out], seed)
    return train_rows, test_rows


def inputs(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    """Model inputs: the columns that are left, by name."""
    return drop_columns(df, excluded).columns


def training_matrix(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Numeric inputs without missing values and the label as an integer."""
    filled = fill_missing(df, features)
    return filled.withColumn(label, F.col(label).cast("int"))


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    test: DataFrame
    metrics: DataFrame


def train(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    key: str,
    trees: int = 11,
    seed: int = 42,
    held_out: int = 33,
    depth: int = 5,
    folder: str | None = None,
) -> Trained:
    """Fit a random forest on two thirds of the rows and score the rest (ML1-ML4).

    The fit reads its rows many times, so they are computed once and written first, to `folder`
    or to a new one below the cluster's shared folder.
    """
    require_columns(df, [label, key, *features])
    rows = training_matrix(df, features, label).where(F.col(label).isNotNull())
    folder = folder or shared_folder(df.sparkSession)
    write_table(rows, folder)
    rows = scan(df.sparkSession, folder)
    train_rows, test_rows = split(rows, key, held_out)
    forest = RandomForestClassifier(
        labelCol=label, featuresCol="_features", predictionCol="_prediction", rawPredictionCol="_raw",
        probabilityCol="_probability", numTrees=trees, seed=seed, maxDepth=depth,
    )
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    model = Pipeline(stages=[assembler, forest]).fit(train_rows.select(label, *features))
    tested = score(model, test_rows)
    return Trained(model, tested, evaluate(tested, label, PREDICTION))


def score(
    model: PipelineModel,
    df: DataFrame,
    probability: str | None = None,
    drop: Sequence[str] = (),
    output: str = PREDICTION,
) -> DataFrame:
    """Rows with the predicted class, and if named the class probabilities (ML3, ML4).

    Inputs are taken by name with missing values as 0.  Keys stay unless dropped.

    The rows are scored by a copy, which has the same trees but no summary of the fit.  The
    summary holds the session and goes to the tasks with the model, and a session in which
    something was observed (`DataFrame.observe`, as in `rolling`) cannot be serialised.
    """
    features = model.stages[0].getInputCols()
    predicted = model.copy().transform(fill_missing(df, features))
    extra = [vector_to_array("_probability").alias(probability)] if probability else []
    kept = [c for c in df.columns if c not in drop]
    return predicted.select(*kept, F.col("_prediction").cast("int").alias(output), *extra)


def save_model(model: PipelineModel, spec: RetrievalSpec, spark: SparkSession, folder: str) -> None:
    """Model and retrieval spec in one folder (ML5)."""
    model.write().save(f"{folder}/model")
    spec.save(spark, folder)


def load_model(spark: SparkSession, folder: str) -> tuple[PipelineModel, RetrievalSpec]:
    return PipelineModel.load(f"{folder}/model"), RetrievalSpec.load(spark, folder)
