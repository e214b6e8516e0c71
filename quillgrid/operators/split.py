"""Exact seeded sampling by class without moving the corpus.

Rows of a class are ordered by ``(md5(seed-id), id)``; a quota of q rows means the
first q in that order. Sorting a class in one window would put a dominant class
into one task. Instead:

1. count rows per (class, first four hex digits of the hash), combined map-side;
2. from the running counts find the bucket that holds the q-th row of each class;
3. rank only the rows of that bucket, about 1/65536 of the class;
4. keep the q-th ``(hash, id)`` as the class's cut and compare every row with it.

Two passes over (id, class), no shuffle of rows, and a cut table of a few rows
per class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgrid.session import broadcast_if_small, materialize
from quillgrid.settings import SEED, TEST_SIZE, VAL_SIZE

BUCKET_DIGITS = 4


def _hash(id_column: str, seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_column).cast("string")))


def bucket_counts(df: DataFrame, class_column: str, id_column: str, seed: int) -> DataFrame:
    """``(class, bucket, n)``, at most 65,536 rows per class."""
    return df.groupBy(
        F.col(class_column).alias("class"),
        F.substring(_hash(id_column, seed), 1, BUCKET_DIGITS).alias("bucket"),
    ).agg(F.count("*").alias("n"))


def class_cuts(
    df: DataFrame,
    counts: DataFrame,
    quotas: DataFrame,
    names: tuple[str, ...],
    class_column: str,
    id_column: str,
    seed: int,
) -> DataFrame:
    """One row per class with a struct ``(hash, id)`` per quota column in ``names``.

    A quota of zero has a NULL cut, which no row is below.
    """
    running = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
        .join(broadcast_if_small(quotas.select("class", *names)), "class")
        .select(
            "class", "bucket", "before", "n",
            F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(c).cast("long").alias("quota")) for c in names])).alias("q"),
        )
        .where((F.col("before") < F.col("q.quota")) & (F.col("q.quota") <= F.col("before") + F.col("n")))
        .select("class", "bucket", "q.cut", (F.col("q.quota") - F.col("before")).alias("place"))
    )
    candidates = df.select(
        F.col(class_column).alias("class"), F.col(id_column).alias("id"), _hash(id_column, seed).alias("hash")
    ).withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS))
    order = Window.partitionBy("class", "cut").orderBy("hash", "id")
    reached = (
        candidates.join(broadcast_if_small(materialize(wanted, "cut-buckets")), ["class", "bucket"])
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") == F.col("place"))
        .select("class", "cut", F.struct("hash", "id").alias("at"))
    )
    return reached.groupBy("class").agg(*[F.max(F.when(F.col("cut") == c, F.col("at"))).alias(c) for c in names])


COUNT = "decimal(19,0)"


def _apportion(classes: DataFrame, size: str, total: str, keep: str, out: str) -> DataFrame:
    """Share ``keep`` of ``total`` rows among classes by largest remainder.

    Windows run over one row per class. Products of two row counts are decimals:
    they outgrow a long from some billions of rows on.
    """
    share = F.col(size).cast(COUNT) * F.col(keep).cast(COUNT)
    missing = F.col(keep) - F.sum("_floor").over(Window.partitionBy())
    by_remainder = Window.orderBy(F.col("_rest").desc(), F.col("class"))
    return (
        classes.withColumn("_share", share)
        .withColumn("_floor", F.expr(f"_share div cast({total} as {COUNT})"))
        .withColumn("_rest", F.col("_share") % F.col(total).cast(COUNT))
        .withColumn("_extra", (F.row_number().over(by_remainder) <= missing).cast("long"))
        .withColumn(out, F.col("_floor") + F.col("_extra"))
        .drop("_share", "_floor", "_rest", "_extra")
    )


def split_quotas(counts: DataFrame, test_size: float = TEST_SIZE, val_size: float = VAL_SIZE) -> DataFrame:
    """``(class, n, n_all, n_test, test, test_and_val)``: sizes per class from bucket counts."""
    everything = Window.partitionBy()
    classes = (
        counts.groupBy("class")
        .agg(F.sum("n").alias("n"))
        .withColumn("n_all", F.sum("n").over(everything))
        .withColumn("n_test", F.ceil(F.col("n_all") * F.lit(float(test_size))))
        .withColumn("n_rest", F.col("n_all") - F.col("n_test"))
        .withColumn("n_val", F.ceil(F.col("n_rest") * F.lit(val_size / (1.0 - test_size))))
        .withColumn("n_train", F.col("n_rest") - F.col("n_val"))
    )
    rest = _apportion(classes, "n", "n_all", "n_rest", "rest")
    train = _apportion(rest, "rest", "n_rest", "n_train", "train")
    return (
        train.withColumn("test", F.col("n") - F.col("rest"))
        .withColumn("test_and_val", F.col("n") - F.col("train"))
    )


def _at_or_below(cut: str) -> Column:
    at = F.col(cut)
    below = (F.col("_hash") < at["hash"]) | ((F.col("_hash") == at["hash"]) & (F.col("_id") <= at["id"]))
    return F.coalesce(below, F.lit(False))


def _with_cuts(df: DataFrame, cuts: DataFrame, class_column: str, id_column: str, seed: int) -> DataFrame:
    keyed = df.withColumn("_hash", _hash(id_column, seed)).withColumn("_id", F.col(id_column))
    renamed = cuts.withColumnRenamed("class", class_column)
    return keyed.join(broadcast_if_small(renamed), class_column, "left")


def stratified_split(
    df: DataFrame,
    label_column: str = "label",
    id_column: str = "doc_id",
    test_size: float = TEST_SIZE,
    val_size: float = VAL_SIZE,
    seed: int = SEED,
) -> DataFrame:
    """Add ``split`` (train, val or test), stratified by label, with exact sizes."""
    counts = materialize(bucket_counts(df, label_column, id_column, seed), "bucket-counts")
    quotas = materialize(split_quotas(counts, test_size, val_size), "split-quotas")
    sizes = quotas.agg(
        F.min("n").alias("smallest"), F.count("*").alias("classes"),
        F.max("n_test").alias("test"), F.max("n_rest").alias("rest"),
        F.max("n_val").alias("val"), F.max("n_train").alias("train"),
    ).first()
    if sizes.classes == 0 or sizes.smallest < 2:
        raise ValueError("every class needs at least two rows to be split")
    if min(sizes.test, sizes.rest, sizes.val, sizes.train) < sizes.classes:
        raise ValueError("each side of the split needs at least one row per class")
    names = ("test", "test_and_val")
    cuts = materialize(class_cuts(df, counts, quotas, names, label_column, id_column, seed), "split-cuts")
    return (
        _with_cuts(df, cuts, label_column, id_column, seed)
        .withColumn(
            "split",
            F.when(_at_or_below("test"), "test").when(_at_or_below("test_and_val"), "val").otherwise("train"),
        )
        .drop("_hash", "_id", *names)
    )


def stratified_folds(df: DataFrame, label_column: str, id_column: str, folds: int, seed: int = SEED) -> DataFrame:
    """Add ``fold`` (0 to folds-1): equal parts of every class, by the same cuts."""
    counts = materialize(bucket_counts(df, label_column, id_column, seed), "bucket-counts")
    names = tuple(f"cut_{i}" for i in range(1, folds))
    classes = counts.groupBy("class").agg(F.sum("n").alias("n"))
    quotas = classes.select("class", *[F.expr(f"n * {i} div {folds}").alias(f"cut_{i}") for i in range(1, folds)])
    cuts = materialize(class_cuts(df, counts, quotas, names, label_column, id_column, seed), "fold-cuts")
    below = reduce(lambda total, name: total + _at_or_below(name).cast("int"), names, F.lit(0))
    return (
        _with_cuts(df, cuts, label_column, id_column, seed)
        .withColumn("fold", F.lit(folds - 1) - below)
        .drop("_hash", "_id", *names)
    )


def sample_rows(df: DataFrame, id_column: str, size: int, seed: int = SEED) -> DataFrame:
    """Exactly ``size`` rows (all if there are fewer), the same for any partitioning."""
    whole = df.withColumn("_class", F.lit(0))
    counts = materialize(bucket_counts(whole, "_class", id_column, seed), "bucket-counts")
    quotas = counts.groupBy("class").agg(F.least(F.sum("n"), F.lit(size)).alias("sample"))
    cuts = materialize(class_cuts(whole, counts, quotas, ("sample",), "_class", id_column, seed), "sample-cut")
    return (
        _with_cuts(whole, cuts, "_class", id_column, seed)
        .where(_at_or_below("sample"))
        .drop("_hash", "_id", "_class", "sample")
    )
