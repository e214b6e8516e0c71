"""From raw columns to a clean labelled corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillgrid.functions.text import clean_text, has_text
from quillgrid.session import broadcast_if_small


def prepare_corpus(df: DataFrame, text_column: str, label_column: str, id_column: str) -> DataFrame:
    """``(doc_id, label, text, text_clean)``: rows with a label and some text.

    One narrow projection: only the three columns are read, and rows are
    dropped before cleaning. A row whose cleaned text is empty stays.
    """
    return (
        df.select(
            F.col(id_column).alias("doc_id"),
            F.col(label_column).alias("label"),
            F.col(text_column).alias("text"),
        )
        .dropna(subset=["label", "text"])
        .where(has_text(F.col("text")))
        .withColumn("text_clean", clean_text(F.col("text")))
    )


def typed_label(df: DataFrame, column: str = "label") -> DataFrame:
    """Labels as integers if every label is one, else as text."""
    whole = df.agg(F.bool_and(F.col(column).try_cast("int").isNotNull()).alias("whole")).first().whole
    return df.withColumn(column, F.col(column).cast("int" if whole else "string"))


def label_dictionary(df: DataFrame, column: str = "label") -> DataFrame:
    """``(label, label_enc)``: distinct labels numbered from 0 in their own order.

    The unpartitioned window sees one row per class only.
    """
    distinct = df.select(F.col(column).alias("label")).dropna().distinct()
    return distinct.withColumn("label_enc", F.dense_rank().over(Window.orderBy("label")) - 1)


def encode_labels(df: DataFrame, dictionary: DataFrame, column: str = "label") -> DataFrame:
    """Add ``label_enc`` from the dictionary; an unknown label gets NULL."""
    codes = dictionary.select(F.col("label").alias(column), "label_enc")
    return df.join(broadcast_if_small(codes), column, "left")


def corpus_profile(df: DataFrame, column: str = "label") -> DataFrame:
    """One row: rows, number of classes, and the sorted classes joined by commas."""
    return (
        df.groupBy(column)
        .agg(F.count("*").alias("rows"))
        .agg(
            F.sum("rows").alias("n_rows"),
            F.count(column).alias("n_classes"),
            F.array_join(F.sort_array(F.collect_list(column)), ",").alias("classes"),
        )
    )
