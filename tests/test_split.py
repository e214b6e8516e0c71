import math

import pytest
from pyspark.sql import functions as F

from quillgrid.operators.prepare import encode_labels, label_dictionary
from quillgrid.operators.split import split_quotas, sample_rows, stratified_folds, stratified_split


def rows(spark, sizes):
    """Classes of the given sizes; one may hold most rows."""
    parts = [spark.range(n).select((F.col("id") * 31 + i).alias("doc_id"), F.lit(name).alias("label")) for i, (name, n) in enumerate(sizes.items())]
    df = parts[0]
    for part in parts[1:]:
        df = df.union(part.withColumn("doc_id", F.col("doc_id") + 1_000_000 * len(df.columns)))
    return df


def counts(df, column):
    return {tuple(r)[:2]: r["count"] for r in df.groupBy("label", column).count().collect()}


def test_sizes_of_the_published_corpus(spark):
    df = stratified_split(spark.range(2225).select(F.col("id").alias("doc_id"), (F.col("id") % 5).alias("label")))
    sizes = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert sizes == {"train": 1557, "val": 223, "test": 445}


def test_skewed_classes_keep_their_share(spark):
    sizes = {"big": 5000, "mid": 301, "low": 17}
    got = counts(stratified_split(rows(spark, sizes)), "split")
    total = sum(sizes.values())
    test = math.ceil(total * 0.2)
    assert sum(n for (_, s), n in got.items() if s == "test") == test
    for name, n in sizes.items():
        assert abs(got[(name, "test")] - n * test / total) <= 1
        assert sum(got[(name, s)] for s in ("train", "val", "test")) == n


def test_same_split_for_any_partitioning(spark):
    df = rows(spark, {"a": 400, "b": 50})
    results = [
        {(r.doc_id, r.label): r.split for r in stratified_split(df.repartition(n)).collect()} for n in (1, 7, 64)
    ]
    assert results[0] == results[1] == results[2]


def test_too_small_classes_are_refused(spark):
    with pytest.raises(ValueError):
        stratified_split(rows(spark, {"a": 40, "b": 1}))
    with pytest.raises(ValueError):
        stratified_split(spark.range(12).select(F.col("id").alias("doc_id"), (F.col("id") % 6).alias("label")))


def test_folds_are_even(spark):
    got = counts(stratified_folds(rows(spark, {"a": 100, "b": 31}), "label", "doc_id", 3), "fold")
    assert sorted(n for (name, _), n in got.items() if name == "a") == [33, 33, 34]
    assert sorted(n for (name, _), n in got.items() if name == "b") == [10, 10, 11]


@pytest.mark.parametrize("size, expected", [(10, 10), (100, 100), (1000, 450)])
def test_sample_size(spark, size, expected):
    df = rows(spark, {"a": 400, "b": 50})
    first = {r.doc_id for r in sample_rows(df.repartition(3), "doc_id", size).collect()}
    second = {r.doc_id for r in sample_rows(df.repartition(11), "doc_id", size).collect()}
    assert len(first) == expected and first == second


def test_codes_follow_the_type_of_the_label(spark):
    numbers = spark.createDataFrame([(10,), (2,), (2,), (33,)], "label int")
    assert {r.label: r.label_enc for r in label_dictionary(numbers).collect()} == {2: 0, 10: 1, 33: 2}
    unknown = spark.createDataFrame([(2,), (99,)], "label int")
    assert {r.label: r.label_enc for r in encode_labels(unknown, label_dictionary(numbers)).collect()} == {2: 0, 99: None}


def test_quotas_of_more_rows_than_a_product_of_longs_holds(spark):
    counts = spark.createDataFrame([("a", 40_000_000_000), ("b", 100), ("c", 9_999_999_999)], "class string, n long")
    quotas = {r["class"]: r for r in split_quotas(counts).collect()}
    assert sum(r.n for r in quotas.values()) == 50_000_000_099
    assert sum(r.test for r in quotas.values()) == quotas["a"].n_test == 10_000_000_020
    assert abs(quotas["a"].test - 8_000_000_000) <= 1 and quotas["b"].test == 20
