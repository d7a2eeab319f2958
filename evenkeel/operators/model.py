"""A small classifier: canonical input layout, fit, score, draw."""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.scalars import argmax_array, pick_index, softmax_array
from .heat import as_list


DEFAULT_PARTITIONS = 8


def canonical_layout(df: DataFrame, key, n: int) -> DataFrame:
    """Rows hashed by key over ``n`` partitions and sorted, however they came in.

    For algorithms whose rounding depends on the order of rows. ``key`` should be unique.
    """
    key = as_list(key)
    return df.repartition(n, *key).sortWithinPartitions(*key)


def fit_classifier(df: DataFrame, key, features: str, label: str, layers: Sequence[int], seed: int,
                   partitions: int = DEFAULT_PARTITIONS, max_iter: int = 50):
    """Multilayer perceptron on an array column, trained on the canonical layout.

    ``partitions`` is part of the layout and no setting of the cluster: keep it equal for equal weights, and
    raise it for large tables. Rows are cached, since training passes over them many times.
    """
    slim = df.select(*as_list(key), array_to_vector(F.col(features).cast("array<double>")).alias("features"),
                     F.col(label).cast("double").alias("label"))
    rows = canonical_layout(slim, key, partitions).persist()
    try:
        return MultilayerPerceptronClassifier(layers=list(layers), seed=seed, maxIter=max_iter, blockSize=128,
                                              featuresCol="features", labelCol="label").fit(rows)
    finally:
        rows.unpersist()


def score(df: DataFrame, model: PipelineModel, key, features: str, temp: Column | float = 1.0, seed: int = 0,
          domain: str = "policy") -> DataFrame:
    """Add ``probs`` (softmax of the model's raw scores), ``best`` and a drawn ``action``.

    Everything is per row: no shuffle.
    """
    raw = model.transform(df.withColumn("features", array_to_vector(F.col(features).cast("array<double>"))))
    probs = raw.withColumn("probs", softmax_array(vector_to_array("rawPrediction"), temp))
    return (probs.withColumn("best", argmax_array("probs"))
            .withColumn("action", pick_index("probs", uniform(seed, domain, *as_list(key))))
            .drop("features", "rawPrediction", "probability", "prediction"))


def prob_of_label(label: str, probs: str = "probs") -> Column:
    return F.element_at(F.col(probs), F.col(label).cast("int") + 1)
