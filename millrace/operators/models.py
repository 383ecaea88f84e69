"""Linear baselines on byte n-grams, and scoring with a model of one's own."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, Normalizer, StringIndexer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.tokens import ngrams
from millrace.operators.metrics import class_weights


def with_terms(df: DataFrame, data: str, low: int = 1, high: int = 4) -> DataFrame:
    return df.withColumn("terms", ngrams(F.col(data), low, high))


def balanced(df: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """df with weight: rows over labels times the label's rows. Labels are few, so their weights are broadcast by size."""
    return df.join(class_weights(df, label, labels).select(F.col("label").alias(label), "weight"), label)


def train_linear(df: DataFrame, label: str, labels: list[str], kind: str = "logistic", terms: int = 200_000) -> PipelineModel:
    """TF-IDF of byte n-grams (column terms), scaled to length 1, into balanced logistic regression or one-against-rest hinge loss."""
    learner = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=50)
    if kind == "hinge":
        learner = OneVsRest(classifier=LinearSVC(maxIter=50), featuresCol="x", labelCol="y", weightCol="weight")
    names = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep")
    rows = balanced(df, label, labels)
    fitted = names.fit(rows)
    stages = [fitted, CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=terms), IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="x"), learner, IndexToString(inputCol="prediction", outputCol="pred_label", labels=fitted.labels)]
    return Pipeline(stages=stages).fit(rows)


def loaded(path: str) -> PipelineModel:
    """A baseline that train_linear() made and its write() saved."""
    return PipelineModel.load(path)


def predicted(model: PipelineModel, df: DataFrame, data: str) -> DataFrame:
    """df with pred_label and, if the learner has them, probabilities as array pred_probs; intermediate columns go."""
    # The first stage numbers the true labels, which only training needs.
    rows = PipelineModel(model.stages[1:]).transform(with_terms(df, data))
    probs = [vector_to_array("probability").alias("pred_probs")] if "probability" in rows.columns else []
    return rows.select(*[c for c in df.columns if c != "pred_label"], "pred_label", *probs)


def scored(df: DataFrame, ids: str, make: Callable[[], Callable[[np.ndarray], np.ndarray]], classes: int, batch: int = 128) -> Column:
    """Array of class scores of a column of equally long id arrays; make is called once in each worker and gives the model."""
    size = df.select(F.size(ids)).first()[0]
    udf = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[[size]])
    return udf(F.col(ids))
