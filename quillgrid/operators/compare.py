"""Comparison of runs. Operators take column names, so any table can be compared.

Inputs are aggregated first; windows without a partition see the few rows of
the result only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def pivot_mean(df: DataFrame, index: str, column: str, value: str, values: Sequence) -> DataFrame:
    """Mean of ``value`` by ``index`` and ``column``; the pivoted values are given, so there is one job."""
    return df.groupBy(index).pivot(column, list(values)).agg(F.avg(value))


def speedup_table(df: DataFrame, name: str, time: str, baseline: str) -> DataFrame:
    """``(pipeline, total_time_s, total_time_min, speedup_vs_serial)``; no speedup without a baseline row."""
    base = F.max(F.when(F.col(name) == baseline, F.col(time))).over(Window.partitionBy())
    return df.select(
        F.col(name).alias("pipeline"),
        F.col(time).alias("total_time_s"),
        F.round(F.col(time) / 60, 2).alias("total_time_min"),
        F.round(base / F.col(time), 2).alias("speedup_vs_serial"),
    )


def strong_scaling(points: DataFrame, x: str = "x", time: str = "total_time") -> DataFrame:
    """Speedup over the smallest ``x``, the ideal one and their ratio, by ascending ``x``."""
    everything = Window.partitionBy()
    return (
        points.withColumn("speedup", F.min_by(F.col(time), F.col(x)).over(everything) / F.col(time))
        .withColumn("ideal", F.col(x) / F.min(x).over(everything))
        .withColumn("efficiency", F.col("speedup") / F.col("ideal"))
        .orderBy(x)
    )


def walltime_table(df: DataFrame, name: str, times: Sequence[str]) -> DataFrame:
    """``(pipeline, minutes)`` from the first time that is there, else 0."""
    return df.select(F.col(name).alias("pipeline"), (F.coalesce(*times, F.lit(0.0)) / 60).alias("minutes"))


def best_per_group(df: DataFrame, group: str, score: str, ties: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The row with the highest score per group, the first by ``ties`` if equal.

    An aggregate rather than a window: a hot group shrinks to one row per task
    before the shuffle.
    """
    rank: list[Column] = [(-F.col(score)).alias("_score"), *[F.col(t) for t in ties]]
    present = df.where(F.col(score).isNotNull())
    row = F.struct(*[F.col(c) for c in keep])
    return present.groupBy(group).agg(F.min_by(row, F.struct(*rank)).alias("best")).select(group, "best.*")


def stage_times(runs: DataFrame, feature_time: str = "feature_fit_transform_time") -> DataFrame:
    """``(stage, seconds)``: feature time, training time per feature, training time.

    The feature time of an extractor is the longest one among its rows, because
    its features are shared by all its models.
    """
    per_feature = runs.groupBy("feature").agg(F.max(feature_time).alias("feature_time"), F.sum("train_time").alias("train_time"))
    training = per_feature.select(F.concat(F.lit("model_training_"), F.col("feature")).alias("stage"), F.col("train_time").alias("seconds"))
    totals = per_feature.agg(F.sum("feature_time").alias("f"), F.sum("train_time").alias("t")).select(
        F.explode(F.array(
            F.struct(F.lit("feature_extraction_total").alias("stage"), F.col("f").alias("seconds")),
            F.struct(F.lit("model_training_total").alias("stage"), F.col("t").alias("seconds")),
        )).alias("row")
    ).select("row.*")
    return training.unionByName(totals)


def union_runs(*runs: DataFrame) -> DataFrame:
    """All rows with all columns; a column a table lacks is NULL."""
    first, *rest = runs
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
