"""Count and TF-IDF features: fitted on training rows, applied without a shuffle.

A fitted model holds at most ``max_features`` terms. Documents are turned into
sparse counts by ``CountVectorizerModel`` and weighted by expressions over the
arrays of one row, so transforming is a narrow step of any size.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from quillgrid.functions.text import tokens, word_ngrams
from quillgrid.operators.vocabulary import term_stats, top_terms
from quillgrid.session import materialize, scratch_path, shuffle_tasks
from quillgrid.settings import (
    MAX_FEATURES_BOW,
    MAX_FEATURES_TFIDF,
    NGRAM_RANGE_BOW,
    NGRAM_RANGE_NGRAM,
    NGRAM_RANGE_TFIDF,
)

# Characters of text, times sizes of n-grams, that a task counts.
TASK_CHARS = 16_000_000


def add_terms(df: DataFrame, token_kind: str, ngram_range: tuple[int, int], text_column: str = "text_clean") -> DataFrame:
    """Add ``tokens``: the terms of each document in reading order per n-gram size."""
    words = df.withColumn("tokens", tokens(F.col(text_column), token_kind))
    if ngram_range == (1, 1):
        return words
    return words.withColumn("tokens", word_ngrams(F.col("tokens"), *ngram_range))


def _unit_length(values: Column) -> Column:
    # The norm is an argument, not an outer reference, so it is computed once per row.
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda total, v: total + v * v))
    return F.zip_with(values, F.array_repeat(norm, F.size(values)), lambda v, n: v / n)


@dataclass(frozen=True)
class TermFeatures:
    """Settings of a term-based extractor."""

    name: str
    ngram_range: tuple[int, int]
    max_features: int
    weighted: bool
    token_kind: str = "default"

    def fit(self, train: DataFrame, text_column: str = "text_clean") -> "TermFeaturesModel":
        spark = train.sparkSession
        found = train.agg(F.count("*").alias("documents"), F.sum(F.length(text_column)).alias("chars")).first()
        # A task's table of counts grows with its terms, so large corpora are counted in more tasks, before and after the shuffle.
        sizes = self.ngram_range[1] - self.ngram_range[0] + 1
        tasks = math.ceil((found["chars"] or 0) * sizes / TASK_CHARS)
        texts = train.select(text_column)
        if tasks > texts.rdd.getNumPartitions():
            texts = texts.repartition(tasks, F.rand(0))
        terms = add_terms(texts, self.token_kind, self.ngram_range, text_column)
        with shuffle_tasks(spark, tasks):
            vocabulary = materialize(top_terms(term_stats(terms), self.max_features), f"vocabulary-{self.name}")
        return TermFeaturesModel(self, vocabulary, found["documents"] if self.weighted else 0, text_column)


@dataclass
class TermFeaturesModel:
    """A vocabulary with its document frequencies."""

    settings: TermFeatures
    vocabulary: DataFrame
    documents: int
    text_column: str = "text_clean"

    @cached_property
    def rows(self) -> list:
        """The vocabulary on the driver; its size is capped by ``max_features``."""
        return self.vocabulary.orderBy("term_id").collect()

    @property
    def size(self) -> int:
        return len(self.rows)

    @cached_property
    def _counter(self) -> CountVectorizerModel:
        # The terms go to the JVM as one string: from_vocabulary copies them one call at a time.
        jvm = self.vocabulary.sparkSession._jvm
        terms = jvm.java.util.regex.Pattern.compile("\n").split("\n".join(row.term for row in self.rows))
        model = CountVectorizerModel(jvm.org.apache.spark.ml.feature.CountVectorizerModel(terms))
        return model.setInputCol("tokens").setOutputCol("_counts")

    @cached_property
    def _idf(self) -> Column:
        weights = [math.log((1.0 + self.documents) / (1.0 + row.df)) + 1.0 for row in self.rows]
        # A constant array, folded once when the query is planned.
        return F.from_json(F.lit(json.dumps(weights)), "array<double>")

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``features``: a struct in the storage layout of a sparse vector."""
        counted = self._counter.transform(add_terms(df, self.settings.token_kind, self.settings.ngram_range, self.text_column))
        plain = counted.withColumn("_counts", F.unwrap_udt("_counts")).drop("tokens")
        values = F.col("_counts.values")
        if self.settings.weighted:
            idf_weights = self._idf
            idf = F.transform(F.col("_counts.indices"), lambda i: F.get(idf_weights, i))
            values = F.zip_with(values, idf, lambda tf, w: (F.lit(1.0) + F.log(tf)) * w)
            plain = plain.withColumn("_values", values)
            values = _unit_length(F.col("_values"))
        return plain.withColumn(
            "features",
            F.struct(
                F.lit(0).cast("tinyint").alias("type"),
                F.col("_counts.size").alias("size"),
                F.col("_counts.indices").alias("indices"),
                values.alias("values"),
            ),
        ).drop("_counts", "_values")

    def transform_long(self, df: DataFrame, id_column: str = "doc_id") -> DataFrame:
        """``(id, term, value)``, one row per document and known term.

        The vocabulary is broadcast: it has at most ``max_features`` rows.
        """
        cells = self.transform(df).select(
            id_column, F.explode(F.arrays_zip("features.indices", "features.values")).alias("cell")
        )
        names = F.broadcast(self.vocabulary.select("term_id", "term"))
        return cells.join(names, F.col("cell.indices") == F.col("term_id")).select(
            id_column, "term", F.col("cell.values").alias("value")
        )


def vector_schema(df: DataFrame, column: str = "features") -> StructType:
    """Schema of ``df`` with the struct column read as an ML vector."""
    return StructType([
        StructField(f.name, VectorUDT() if f.name == column else f.dataType, f.nullable) for f in df.schema.fields
    ])


def read_features(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read stored features, the struct column as ML vectors."""
    return spark.read.schema(schema).parquet(path)


def as_vectors(df: DataFrame, name: str = "features") -> DataFrame:
    """Materialize the struct column and return it as an ML vector column.

    Iterative training reads its input many times, so it reads stored features.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(vector_schema(df)).parquet(path)


def bow(token_kind: str = "default") -> TermFeatures:
    return TermFeatures("bow", NGRAM_RANGE_BOW, MAX_FEATURES_BOW, False, token_kind)


def tfidf(token_kind: str = "default") -> TermFeatures:
    return TermFeatures("tfidf", NGRAM_RANGE_TFIDF, MAX_FEATURES_TFIDF, True, token_kind)


def ngram(token_kind: str = "default") -> TermFeatures:
    return TermFeatures("ngram", NGRAM_RANGE_NGRAM, MAX_FEATURES_TFIDF, True, token_kind)


def dense_struct(column: str):
    """An array column in the storage layout of a dense ML vector."""
    return F.struct(
        F.lit(1).cast("tinyint").alias("type"),
        F.lit(None).cast("int").alias("size"),
        F.lit(None).cast("array<int>").alias("indices"),
        F.col(column).cast("array<double>").alias("values"),
    )
