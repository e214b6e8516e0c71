"""Comparison of the run files in a results folder."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillgrid.operators.compare import best_per_group, pivot_mean, speedup_table, strong_scaling, walltime_table
from quillgrid.plans.grid import run_grid
from quillgrid.sinks.runs import export_runs, meta_frame, write_csv, write_runs
from quillgrid.sources.runs import pipeline_of, scan_runs, scan_scaling, scored_runs, total_time, typed_runs


def analyse(spark: SparkSession, folder: str, out: str | None = None, baseline: str = "serial") -> dict[str, DataFrame]:
    """All comparison tables of ``<folder>/results_*.txt`` and its scaling folders.

    With ``out`` the summary and the speedup table are also written as CSV.
    """
    base = folder.rstrip("/")
    meta, cells = scan_runs(spark, f"{base}/results_*.txt")
    runs = scored_runs(typed_runs(cells, pipeline_of(F.col("path")))).persist()
    names = {c: sorted(r[0] for r in runs.select(c).distinct().collect()) for c in ("feature", "model")}
    times = meta.select(pipeline_of(F.col("path")).alias("pipeline"), total_time("meta").alias("total_time"))
    tables = {
        "summary": runs,
        "accuracy": pivot_mean(runs.withColumn("row", F.concat_ws("/", "pipeline", "feature")), "row", "model", "test_accuracy", names["model"]),
        "f1": pivot_mean(runs.withColumn("row", F.concat_ws("/", "pipeline", "feature")), "row", "model", "test_f1_macro", names["model"]),
        "train_time": pivot_mean(runs.withColumn("row", F.concat_ws("/", "pipeline", "model")), "row", "feature", "train_time", names["feature"]),
        "walltime": walltime_table(times, "pipeline", ["total_time"]),
        "speedup": speedup_table(times, "pipeline", "total_time", baseline),
        "scaling_jobs": strong_scaling(scan_scaling(spark, f"{base}/scaling")),
        "scaling_nodes": strong_scaling(scan_scaling(spark, f"{base}/mpi_scaling", "nodes_", "results_mpi.txt", ("total_time",))),
        "best": best_per_group(
            runs, "pipeline", "test_f1_macro", ("feature", "model"), ("feature", "model", "test_accuracy", "test_f1_macro")
        ),
    }
    if out:
        write_csv(tables["summary"], f"{out}/summary.csv")
        write_csv(tables["speedup"], f"{out}/speedup_table.csv")
    return tables


def run_all(corpus: DataFrame, folder: str, variants: Sequence[str] = ("default", "optimized"), **options) -> dict[str, DataFrame]:
    """Run the grid in each setting, store run files and the run table, and compare them.

    ``corpus`` is split already; ``options`` are those of ``run_grid``. Features are
    made anew in each setting unless ``use_cache`` says otherwise, so that times
    compare work with work.
    """
    spark = corpus.sparkSession
    for variant in variants:
        start = time.perf_counter()
        runs = run_grid(corpus, variant=variant, **{"use_cache": False, **options})
        meta = {"total_time": time.perf_counter() - start}
        export_runs(runs, f"{folder}/results_{variant}.txt", meta_frame(spark, meta))
        write_runs(runs, f"{folder}/runs")
    return analyse(spark, folder, folder, baseline=variants[0])
