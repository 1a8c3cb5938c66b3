"""Spark ML pipelines: correction prediction and document classification."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import blank_to_null
from ledgerloom.operators.features import WORD

SEED = 42


def _tokenizer(text_col: str) -> RegexTokenizer:
    return RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=WORD, gaps=False, toLowercase=True)


def train_corrections(
    corrections: DataFrame,
    features: int = 1 << 14,
    trees: int = 20,
    depth: int = 5,
) -> PipelineModel:
    """Predict the corrected value from the original one.

    Rows with a null cannot be trained on and are left out. Equal pairs are
    counted first and enter the forest once with their count as weight, so a
    correction repeated a million times costs as much as one. Words are hashed,
    so none is left out. Train per field: a forest knows the values of its rows.
    """
    pairs = (
        corrections.select("original_value", "corrected_value").dropna()
        .groupBy("original_value", "corrected_value").agg(F.count("*").cast("double").alias("_weight"))
    ).persist()
    try:
        indexer = StringIndexer(inputCol="corrected_value", outputCol="_label").fit(pairs)
        stages = [
            _tokenizer("original_value"),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
            IDF(inputCol="_counts", outputCol="_features"),
            RandomForestClassifier(
                featuresCol="_features", labelCol="_label", predictionCol="_prediction",
                weightCol="_weight", numTrees=trees, maxDepth=depth, seed=SEED,
            ),
            IndexToString(inputCol="_prediction", outputCol="predicted_value", labels=indexer.labels),
        ]
        return Pipeline(stages=stages).fit(indexer.transform(pairs))
    finally:
        pairs.unpersist()


def predict_corrections(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``predicted_value`` for the text in ``original_value``."""
    filled = rows.withColumn("original_value", F.coalesce("original_value", F.lit("")))
    return model.transform(filled).select(*rows.columns, "predicted_value")


def merge_prediction(value: Column, predicted: Column, mode: str = "fill") -> Column:
    """Use a prediction to fill empty values only, or to overwrite every value."""
    if mode == "fill":
        return F.coalesce(blank_to_null(value), predicted)
    if mode == "overwrite":
        return F.coalesce(predicted, value)
    raise ValueError(f"unknown mode: {mode}")


def train_classifier(docs: DataFrame, text_col: str, label_col: str, features: int = 1 << 16) -> PipelineModel:
    """Classify documents by their text (hashed TF-IDF, logistic regression)."""
    stages = [
        _tokenizer(text_col),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features"),
        LogisticRegression(
            featuresCol="_features", labelCol=label_col, predictionCol="_prediction",
            maxIter=20, regParam=0.01,
        ),
    ]
    return Pipeline(stages=stages).fit(docs)


def classify(model: PipelineModel, docs: DataFrame) -> DataFrame:
    return model.transform(docs).select(*docs.columns, F.col("_prediction").cast("int").alias("predicted"))
