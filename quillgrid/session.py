"""Session, shared scratch space and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType

from quillgrid.settings import BROADCAST_LIMIT, BROADCAST_ROWS


def local_session(app_name: str = "quillgrid", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quillgrid-"))
    return context.getCheckpointDir()


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark).rstrip('/')}/quillgrid/run-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of this application."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; call it when no result that reads them is needed any more.

    Features that were stored for later runs stay.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs one file read, and evaluates a
    shared input once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_rows(df: DataFrame) -> DataFrame:
    """Give every core some rows of an input that is cut into fewer tasks than cores.

    A small corpus in one file is one task. An input with enough tasks, as any
    large one has, is left as scanned: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextmanager
def shuffle_tasks(spark: SparkSession, tasks: int) -> Iterator[None]:
    """At least so many tasks after each shuffle of the actions inside; AQE merges those that stay small."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(tasks, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def single_rows(spark: SparkSession) -> Iterator[None]:
    """Rows reach Python one to a batch in the actions inside: for rows that are blocks of many megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _row_bytes(df: DataFrame) -> Column:
    """About how much a row takes in memory: bytes of texts, 16 for each array element or other value."""
    total = F.lit(0).cast("long")
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            part = F.octet_length(column)
        elif isinstance(field.dataType, (ArrayType, MapType)):
            part = F.size(column) * 16
        else:
            part = F.lit(16)
        total = total + F.coalesce(part.cast("long"), F.lit(0)) + 16
    return total


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast after counting rows and bytes; a larger side keeps the shuffle join.

    AQE splits a skewed key of the shuffle join, so a hot key stays spread.
    """
    found = df.select(_row_bytes(df).alias("bytes")).limit(max_rows + 1).agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).first()
    return F.broadcast(df) if found["rows"] <= max_rows and (found["bytes"] or 0) <= max_bytes else df


def spread_groups(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Shuffle by group key into a set number of tasks.

    Work per group is in Python and costs far more than its bytes suggest, so
    AQE must not merge the tasks by size.
    """
    tasks = min(groups, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(1, tasks), *keys)
