"""Writers for run tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType


def _cell(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, (DoubleType, FloatType)):
        return F.when(F.col(column).isNotNull(), F.format_string("%.6f", F.col(column))).otherwise("")
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def meta_lines(meta: Mapping) -> list[str]:
    """``key: value`` lines; nested mappings one level down, floats to four places."""
    lines = []
    for key, value in meta.items():
        for name, item in value.items() if isinstance(value, Mapping) else [(key, value)]:
            lines.append(f"{name}: {item:.4f}" if isinstance(item, float) else f"{name}: {item}")
    return lines


def run_lines(runs: DataFrame, meta: DataFrame | None = None, order: Sequence[str] = ("feature", "model")) -> DataFrame:
    """``(line)`` of one run file: metadata rows ``(place, line)``, a blank line, the table.

    One line per grid cell: the sort at the end is over a table of that size.
    """
    columns = [c for c in runs.columns if c != "pipeline"]
    spark = runs.sparkSession
    header = spark.range(1).select(F.lit(1).alias("section"), F.lit("").alias("key"), F.lit("\t".join(columns)).alias("line"))
    blank = spark.range(1).select(F.lit(0).alias("section"), F.lit("~").alias("key"), F.lit("").alias("line"))
    key = F.concat_ws("\t", *[F.col(c) for c in order])
    table = runs.select(F.lit(2).alias("section"), key.alias("key"), F.concat_ws("\t", *[_cell(runs, c) for c in columns]).alias("line"))
    parts = blank.unionByName(header).unionByName(table)
    if meta is not None:
        parts = parts.unionByName(meta.select(F.lit(-1).alias("section"), F.lpad("place", 9, "0").alias("key"), "line"))
    return parts.orderBy("section", "key").select("line")


def meta_frame(spark: SparkSession, meta: Mapping) -> DataFrame:
    """Metadata known to the driver, as rows ``(place, line)``."""
    return spark.createDataFrame(list(enumerate(meta_lines(meta))), "place int, line string")


def export_runs(runs: DataFrame, path: str, meta: DataFrame | None = None, order: Sequence[str] = ("feature", "model")) -> None:
    """Write one run file (a folder with one part) for a table the size of the grid."""
    run_lines(runs, meta, order).coalesce(1).write.text(path)


def write_runs(runs: DataFrame, path: str) -> None:
    """Store run rows as a table by pipeline."""
    runs.write.mode("append").partitionBy("pipeline").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Summary or speedup table as CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)
