"""Run files: ``key: value`` lines, a blank line, a tab-separated table.

Run files are small and many. Each is read whole as one row, so a set of files
is one job, and parsed by expressions over the arrays of that row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from quillgrid.settings import MISSING_TOKENS

TEXT_COLUMNS = ("feature", "model")
NUMBER_COLUMNS = (
    "feature_fit_transform_time", "feature_transform_val_time", "feature_transform_test_time", "feature_time",
    "train_time", "inference_val_time", "inference_test_time", "inference_time",
    "val_accuracy", "val_f1_macro", "val_f1_weighted",
    "test_accuracy", "test_f1_macro", "test_f1_weighted",
)
# The union of the columns of all kinds of run files.
RUN_SCHEMA = StructType(
    [StructField("pipeline", StringType())]
    + [StructField(c, StringType()) for c in TEXT_COLUMNS]
    + [StructField(c, DoubleType()) for c in NUMBER_COLUMNS]
    + [StructField("error", StringType())]
)


def read_run_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(path, meta, lines)``: metadata as a map, the table as its lines."""
    whole = spark.read.text(paths, wholetext=True).select(
        F.input_file_name().alias("path"), F.concat(F.lit("\n"), F.col("value")).alias("value")
    )
    halves = whole.select("path", F.split("value", r"\n[ \t\r]*\n", 2).alias("halves"))

    def entry(line: Column) -> Column:
        return F.struct(
            F.trim(F.substring_index(line, ":", 1)).alias("key"),
            F.trim(F.regexp_replace(F.regexp_extract(line, r"^[^:]*:(.*)$", 1), r"\r$", "")).alias("value"),
        )

    lines = F.filter(F.split(F.get("halves", 0), "\n"), lambda line: F.trim(line) != "")
    entries = F.transform(lines, entry)
    # A key given twice keeps its last value.
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    backwards = halves.select("path", keys.alias("keys"), F.reverse(entries).alias("entries"), F.get("halves", 1).alias("body"))
    meta = F.map_from_arrays(
        "keys", F.transform("keys", lambda k: F.get(F.filter(F.col("entries"), lambda e: e["key"] == k), 0)["value"])
    )
    body = F.filter(F.split(F.coalesce("body", F.lit("")), r"\r?\n"), lambda line: F.trim(line) != "")
    return backwards.select("path", meta.alias("meta"), body.alias("lines"))


def scan_runs(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(meta, cells)``: one row per file, and one row per table row with a map of its cells."""
    files = read_run_files(spark, paths)
    header = F.split(F.get("lines", 0), "\t")
    rows = files.where(F.size("lines") > 1).select(
        "path", header.alias("header"), F.posexplode(F.slice("lines", 2, 1 << 30)).alias("row", "line")
    )
    values = F.split("line", "\t")
    filled = F.concat(values, F.array_repeat(F.lit(""), F.greatest(F.size("header") - F.size(values), F.lit(0))))
    cells = F.map_from_arrays("header", F.slice(filled, F.lit(1), F.size("header")))
    return files.select("path", "meta"), rows.select("path", "row", cells.alias("cells"))


def typed_runs(cells: DataFrame, pipeline: Column) -> DataFrame:
    """Run rows in the fixed schema; a column the file lacks, or a cell that is no number, is NULL."""
    def cell(name: str) -> Column:
        value = F.element_at("cells", F.lit(name))
        return F.when(~value.isin(*MISSING_TOKENS), value)

    return cells.select(
        pipeline.alias("pipeline"),
        *[cell(c).alias(c) for c in TEXT_COLUMNS],
        *[cell(c).try_cast("double").alias(c) for c in NUMBER_COLUMNS],
        cell("error").alias("error"),
    )


def scored_runs(runs: DataFrame) -> DataFrame:
    """Drop rows without a test score: failed cells."""
    return runs.where(F.col("test_accuracy").isNotNull())


def pipeline_of(path: Column) -> Column:
    """``serial`` from ``…/results_serial.txt`` or a part of it."""
    return F.regexp_extract(path, r"results_([^/.]+)\.txt", 1)


def total_time(meta: Column | str, keys: Sequence[str] = ("total_time", "total_wall_time")) -> Column:
    """The first of the keys that the metadata has, as a number."""
    return F.coalesce(*[F.element_at(meta, F.lit(k)) for k in keys]).try_cast("double")


def scan_scaling(
    spark: SparkSession,
    folder: str,
    prefix: str = "njobs_",
    file_name: str = "results_parallel.txt",
    keys: Sequence[str] = ("total_wall_time", "total_time"),
) -> DataFrame:
    """``(x, total_time)`` over the folders ``<prefix><x>``; empty if there are none."""
    pattern = f"{folder.rstrip('/')}/{prefix}*/{file_name}"
    try:
        files = read_run_files(spark, pattern)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], StructType([StructField("x", IntegerType()), StructField("total_time", DoubleType())]))
    x = F.regexp_extract("path", f"/{prefix}(\\d+)/", 1).try_cast("int")
    return files.select(x.alias("x"), total_time("meta", keys).alias("total_time")).orderBy("x")
