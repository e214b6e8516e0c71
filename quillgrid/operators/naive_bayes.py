"""Complement naive Bayes on non-negative features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import NaiveBayes, NaiveBayesModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from quillgrid.settings import NB_ALPHA


def smallest_value(df: DataFrame, features: str = "features") -> float:
    """Least feature value, counting the absent entries of a sparse vector as 0."""
    parts = df.select(F.unwrap_udt(features).alias("v"))
    least = F.array_min("v.values")
    absent = F.when((F.col("v.type") == 0) & (F.size("v.indices") < F.col("v.size")), F.lit(0.0))
    return parts.agg(F.min(F.least(least, absent))).first()[0] or 0.0


def shift_up(vector: Column, least: float) -> Column:
    """Move a dense vector up by the least training value, cut off at 0."""
    moved = F.transform(vector_to_array(vector), lambda x: F.greatest(x - F.lit(least), F.lit(0.0)))
    return array_to_vector(moved)


@dataclass(frozen=True)
class ShiftedNaiveBayes:
    """A complement model and the shift that its features need."""

    model: NaiveBayesModel
    least: float
    features: str

    def transform(self, df: DataFrame) -> DataFrame:
        if self.least >= 0:
            return self.model.transform(df)
        moved = df.withColumn("_features", df[self.features]).withColumn(
            self.features, shift_up(F.col(self.features), self.least)
        )
        scored = self.model.transform(moved)
        return scored.withColumn(self.features, F.col("_features")).drop("_features")


def fit_naive_bayes(
    train: DataFrame, label: str = "label_enc", features: str = "features", alpha: float = NB_ALPHA
) -> ShiftedNaiveBayes:
    """Fit on training rows; negative features are shifted by the training minimum.

    Class totals per feature are one aggregate of (classes × features) numbers.
    """
    least = smallest_value(train, features)
    ready = train if least >= 0 else train.withColumn(features, shift_up(F.col(features), least))
    estimator = NaiveBayes(modelType="complement", smoothing=alpha, labelCol=label, featuresCol=features)
    return ShiftedNaiveBayes(estimator.fit(ready), least, features)
