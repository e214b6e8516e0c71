"""Term statistics and the capped vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillgrid.session import broadcast_if_small, materialize


def term_stats(df: DataFrame, tokens_column: str = "tokens") -> DataFrame:
    """``(term, ctf, df)``: occurrences in the corpus and documents holding the term.

    Occurrences and the distinct terms of each document are counted in one
    aggregate, so there is one shuffle, keyed by term and combined map-side. A
    term that makes up a third of all tokens arrives as one row per map task.
    """
    occurrence = F.transform(
        tokens_column, lambda t: F.struct(t.alias("term"), F.lit(1).alias("ctf"), F.lit(0).alias("df"))
    )
    document = F.transform(
        F.array_distinct(tokens_column),
        lambda t: F.struct(t.alias("term"), F.lit(0).alias("ctf"), F.lit(1).alias("df")),
    )
    return (
        df.select(F.explode(F.concat(occurrence, document)).alias("row"))
        .groupBy(F.col("row.term").alias("term"))
        .agg(F.sum("row.ctf").alias("ctf"), F.sum("row.df").alias("df"))
    )


def top_terms(stats: DataFrame, max_terms: int) -> DataFrame:
    """``(term, term_id, ctf, df)``: the most frequent terms, ties by term.

    The limit keeps ``max_terms`` rows per task before the final merge; the
    numbering sees only the rows kept.
    """
    kept = stats.orderBy(F.col("ctf").desc(), F.col("term")).limit(max_terms)
    place = F.row_number().over(Window.orderBy(F.col("ctf").desc(), F.col("term")))
    return kept.withColumn("term_id", place - 1).select("term", "term_id", "ctf", "df")


def _counts_of_rows(df: DataFrame, id_column: str, tokens_column: str) -> DataFrame:
    """``(id, term, n)`` of each row: its terms are sorted, and where one ends its place less that of the one before is its number."""
    # No filter here: it would be pushed below the projection and make the terms twice. A missing neighbour is null.
    ordered = df.select(id_column, F.sort_array(tokens_column).alias("_terms"))
    size = F.size("_terms")
    placed = ordered.select(id_column, F.arrays_zip(
        F.col("_terms").alias("term"), F.slice("_terms", F.lit(2), F.greatest(size, F.lit(0))).alias("after"),
        F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")).alias("at"),
    ).alias("_placed"))
    ends = placed.select(id_column, F.filter("_placed", lambda x: x["after"].isNull() | (x["term"] != x["after"])).alias("_ends"))
    before = F.slice(F.concat(F.array(F.lit(0)), F.col("_ends.at")), F.lit(1), F.greatest(F.size("_ends"), F.lit(0)))
    numbers = F.zip_with("_ends.at", before, lambda at, last: (at - last).cast("long"))
    cells = ends.select(id_column, F.explode(F.arrays_zip(F.col("_ends.term").alias("term"), numbers.alias("n"))).alias("_cell"))
    return cells.select(id_column, "_cell.term", "_cell.n")


def term_counts(df: DataFrame, id_column: str, tokens_column: str = "tokens") -> DataFrame:
    """``(id, term, n)``: how often each term occurs under each id.

    Terms are counted within their row; only ids are shuffled, and the counts of
    rows whose id occurs more than once (a null is an id too).
    """
    repeated = df.groupBy(F.col(id_column).alias("_id")).agg(F.count("*").alias("_rows")).where("_rows > 1").select("_id")
    repeated = materialize(repeated, "repeated-ids")
    if repeated.isEmpty():
        return _counts_of_rows(df, id_column, tokens_column)
    repeated, same = broadcast_if_small(repeated), F.col(id_column).eqNullSafe(F.col("_id"))
    once = _counts_of_rows(df.join(repeated, same, "left_anti"), id_column, tokens_column)
    several = _counts_of_rows(df.join(repeated, same, "left_semi"), id_column, tokens_column)
    return once.union(several.groupBy(id_column, "term").agg(F.sum("n").alias("n")))
