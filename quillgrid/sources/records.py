"""Records of delimited files that hold line breaks inside quotes, read in splits.

Spark's own multi-line reader gives a whole file to one task. Here files are cut
at any line, and lines are put together again:

1. Each line maps the state before it (inside quotes or not) to the state after
   it. Two patterns give both answers, so a line can be judged alone.
2. These maps are composed within each file block and then over the blocks of a
   file, of which there are as many as the file has splits.
3. Lines of a record are joined within their block. Only the last, open record
   of a block and the continuation at its start cross blocks, so at most two
   pieces per block are joined over a file.

Lines are shuffled once, by block; no task gets more than one block of a file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

QUOTED = r'[^"]*+(?:""[^"]*+)*+'


def line_states(line: Column, separator: str) -> tuple[Column, Column]:
    """State after the line (1 inside quotes) if it starts outside, and if it starts inside."""
    mark = re.escape(separator)
    opens = rf'^(?:(?:"{QUOTED}"[^{mark}]*+|[^"{mark}][^{mark}]*+|){mark})*+"{QUOTED}$'
    closed = rf'^{QUOTED}"(.*)$'
    # What follows a closing quote is the end of an unquoted cell.
    rest = F.concat(F.lit("x"), F.regexp_extract(line, closed, 1))
    outside = line.rlike(opens).cast("int")
    inside = F.when(line.rlike(closed), rest.rlike(opens).cast("int")).otherwise(F.lit(1))
    return outside, inside


def _after(df: DataFrame, keys: tuple[str, ...], order: str, start: Column) -> DataFrame:
    """Add ``after``: the state after each row, from ``outside`` and ``inside`` in order.

    A row that ends the same way from both states sets the state; one that swaps
    them toggles it; any other keeps it.
    """
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    toggles = F.sum(((F.col("outside") == 1) & (F.col("inside") == 0)).cast("int")).over(window)
    counted = df.withColumn("_t", toggles)
    fixed = F.when(F.col("outside") == F.col("inside"), (F.col("outside") + F.col("_t")) % 2)
    last = F.last(fixed, ignorenulls=True).over(window)
    return counted.withColumn("after", ((F.coalesce(last, start) + F.col("_t")) % 2).cast("int")).drop("_t")


def read_records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``(record, is_first)``: every record of the files, the first one with text of each file marked.

    A line ends with a line feed, a carriage return, or both; line ends inside quotes stay as they
    are. A record whose quote is never closed runs to the end of its file; it is
    dropped before its lines are put together. A file without any line feed is one
    line to Spark's reader and so one task.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value"),
    )
    # A byte-order mark is no text.
    value = F.when(F.col("block") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    cut = lines.withColumn("parts", F.split(value, r"\r(?!\z)")).select(
        "file", "block", "row", F.size("parts").alias("_n"), F.posexplode("parts").alias("piece", "part")
    )
    is_last = F.col("piece") == F.col("_n") - 1
    tail = F.when(~is_last, "\r").when(F.col("part").endswith("\r"), "\r\n").otherwise("\n")
    pieces = cut.select(
        "file", "block", F.struct("row", "piece").alias("at"), F.regexp_replace("part", r"\r\z", "").alias("line"), tail.alias("tail")
    )
    outside, inside = line_states(F.col("line"), separator)
    mapped = pieces.withColumn("outside", outside).withColumn("inside", inside)

    # The map of a whole block: where it ends from either state.
    in_block = Window.partitionBy("file", "block").orderBy("at")
    both = _after(mapped, ("file", "block"), "at", F.lit(0)).withColumnRenamed("after", "from_outside")
    both = _after(both, ("file", "block"), "at", F.lit(1)).withColumnRenamed("after", "from_inside")
    both = both.withColumn("reopens", (F.col("from_inside") == 0) & F.lead("at").over(in_block).isNotNull())
    blocks = both.groupBy("file", "block").agg(
        F.max_by("from_outside", "at").alias("outside"), F.max_by("from_inside", "at").alias("inside"), F.max("reopens").alias("reopens"),
        F.max(F.trim("line") != "").alias("has_text"),
    )
    in_file, whole_file = Window.partitionBy("file").orderBy("block"), Window.partitionBy("file")
    # A block holds the start of a record if it starts outside quotes or leaves them before its last line.
    starts = _after(blocks, ("file",), "block", F.lit(0)).withColumn("start", F.lag("after", 1, 0).over(in_file)).select(
        "file", "block", "start", F.max_by("after", "block").over(whole_file).alias("unclosed"),
        F.max(F.when((F.col("start") == 0) | F.col("reopens"), F.col("block"))).over(whole_file).alias("last_start"),
        F.min(F.when(F.col("has_text"), F.col("block"))).over(whole_file).alias("first_block"),
    )
    known = (
        both.join(starts, ["file", "block"])
        .withColumn("after", F.when(F.col("start") == 1, F.col("from_inside")).otherwise(F.col("from_outside")))
        .withColumn("before", F.coalesce(F.lag("after").over(in_block), F.col("start")))
        .withColumn("record", F.sum((F.col("before") == 0).cast("int")).over(in_block))
        .withColumn("records", F.max("record").over(Window.partitionBy("file", "block")))
    )
    endless = (F.col("unclosed") == 1) & (
        (F.col("block") > F.col("last_start")) | ((F.col("block") == F.col("last_start")) & (F.col("record") == F.col("records")))
    )
    joined = (
        known.where(~endless).withColumn("text", F.concat("line", "tail")).groupBy("file", "block", "record")
        .agg(_in_order("at", "text").alias("text"), F.max_by("after", "at").alias("open"), F.min("first_block").alias("first_block"))
        .withColumn("first_record", F.min(F.when(F.trim(F.regexp_replace("text", r"[\r\n]", "")) != "", F.col("record"))).over(
            Window.partitionBy("file", "block")))
    )
    complete = (F.col("record") > 0) & (F.col("open") == 0)
    whole = joined.where(complete).select("file", "block", "record", "first_block", "first_record", "text")
    parts = joined.where(~complete)
    number = F.sum((F.col("record") > 0).cast("int")).over(Window.partitionBy("file").orderBy("block", "record"))
    mended = (
        parts.withColumn("number", number)
        .groupBy("file", "number")
        .agg(
            F.min("block").alias("first"), F.min_by("record", "block").alias("record"),
            F.min("first_block").alias("first_block"), F.min_by("first_record", "block").alias("first_record"), _in_order("block", "text").alias("text"),
        )
        .select("file", F.col("first").alias("block"), "record", "first_block", "first_record", "text")
    )
    return whole.unionByName(mended).select(
        F.regexp_replace("text", r"(?:\r\n|\n|\r)\z", "").alias("record"),
        ((F.col("block") == F.col("first_block")) & (F.col("record") == F.col("first_record"))).alias("is_first"),
    )


def _in_order(order: str, text: str) -> Column:
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return F.array_join(F.transform(parts, lambda part: part[text]), "")
