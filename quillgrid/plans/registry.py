"""Extractors and models by name, in two settings."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from quillgrid.operators import classifiers, features
from quillgrid.operators.document_vectors import DocumentVectorFeatures
from quillgrid.operators.naive_bayes import fit_naive_bayes
from quillgrid.operators.word_vectors import WordVectorFeatures

# Fits on training rows; validation rows serve models that stop early.
Fit = Callable[[DataFrame, DataFrame], Any]

EXTRACTORS: dict[str, dict[str, Callable[[], Any]]] = {
    "default": {
        "bow": features.bow,
        "tfidf": features.tfidf,
        "ngram": features.ngram,
        "word2vec": WordVectorFeatures,
        "doc2vec": DocumentVectorFeatures,
    },
    "optimized": {
        "bow": lambda: features.bow("strict"),
        "tfidf": lambda: features.tfidf("strict"),
        "ngram": lambda: features.ngram("strict"),
        "word2vec": WordVectorFeatures,
        "doc2vec": DocumentVectorFeatures,
    },
}

_MODELS: dict[str, Fit] = {
    "logistic_regression": lambda train, val: classifiers.fit_logistic_regression(train),
    "random_forest": lambda train, val: classifiers.fit_random_forest(train),
    "boosted_trees": lambda train, val: classifiers.fit_boosted_trees(train),
    "svm": lambda train, val: classifiers.fit_linear_svm(train),
    "naive_bayes": lambda train, val: fit_naive_bayes(train),
    "knn": lambda train, val: classifiers.fit_neighbours(train),
    "mlp": lambda train, val: classifiers.fit_mlp(train),
}

MODELS: dict[str, dict[str, Fit]] = {
    "default": _MODELS,
    "optimized": {
        **_MODELS,
        "boosted_trees": classifiers.fit_boosted_trees_early_stop,
        "svm": lambda train, val: classifiers.fit_calibrated_svm(train),
    },
}
