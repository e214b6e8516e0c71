"""Exact k nearest neighbours by cosine distance, block by block.

Queries and training rows are spread over blocks of bounded size by hash. Every
pair of blocks is one group, compared by a matrix product inside a task, which
returns k rows per query rather than all pairs. The best k over the blocks are
then chosen per query. Comparing all rows is what an exact answer needs; no
block, group or task grows with the data, only their number does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgrid.session import spread_groups
from quillgrid.settings import KNN_K

# Larger blocks repeat fewer rows; a slice of a block is what is compared at once.
BLOCK_ROWS = 20_000
SLICE_ROWS = 512


def sparse_parts(features: Column) -> list[Column]:
    """``size, indices, values`` of an ML vector or of a stored feature struct."""
    return [features["size"].alias("size"), features["indices"].alias("indices"), features["values"].alias("values")]


def dense_parts(vector: Column) -> list[Column]:
    """The same parts of an array column."""
    return [
        F.size(vector).alias("size"),
        F.lit(None).cast("array<int>").alias("indices"),
        vector.cast("array<double>").alias("values"),
    ]


def _unit_cells(part: pd.DataFrame) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """(indices, values) of each row at unit length; indices are None for a dense row, a zero row stays zero."""
    rows = []
    for indices, values in zip(part["indices"], part["values"]):
        values = np.asarray(values, dtype=np.float64)
        norm = float(np.sqrt(values @ values))
        rows.append((None if indices is None else np.asarray(indices), values / norm if norm > 0 else values))
    return rows


def _columns(rows: list[tuple[np.ndarray | None, np.ndarray]], width: int) -> np.ndarray:
    """A slice of rows as the columns of a dense matrix."""
    matrix = np.zeros((width, len(rows)))
    for at, (indices, values) in enumerate(rows):
        matrix[slice(len(values)) if indices is None else indices, at] = values
    return matrix


def _products(rows: list[tuple[np.ndarray | None, np.ndarray]], columns: np.ndarray) -> np.ndarray:
    """Products of rows with all columns; a sparse row reads only the lines of its own indices."""
    return np.stack([values @ columns[slice(len(values)) if indices is None else indices] for indices, values in rows])


def _best(distance: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least per row, by distance, then by id, so that equal distances have one answer."""
    order = np.lexsort((ids, distance), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (distance, ids, labels))


def _nearest_in_block(k: int):
    def compare(queries: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        found = {"id": np.array([], "int64"), "train_id": np.array([], "int64"), "label": np.array([], "int32"), "distance": np.array([])}
        if len(queries) and len(train):
            width = max(int(queries["size"].max()), int(train["size"].max()))
            left, right = _unit_cells(queries), _unit_cells(train)
            ids, labels = train["id"].to_numpy(), train["label"].to_numpy()
            kept: list = [None] * -(-len(left) // SLICE_ROWS)
            for at in range(0, len(right), SLICE_ROWS):
                columns = _columns(right[at:at + SLICE_ROWS], width)
                for number in range(len(kept)):
                    products = _products(left[number * SLICE_ROWS:(number + 1) * SLICE_ROWS], columns)
                    distance = np.round(1.0 - products, 9)
                    now = _best(distance, *(np.broadcast_to(x[at:at + SLICE_ROWS], distance.shape) for x in (ids, labels)), k)
                    # The best so far and the new ones: k rows per query leave a slice, and the block.
                    both = now if kept[number] is None else tuple(np.concatenate(x, axis=1) for x in zip(kept[number], now))
                    kept[number] = _best(*both, k)
            distance, train_ids, train_labels = (np.concatenate(x) for x in zip(*kept))
            found = {
                "id": np.repeat(queries["id"].to_numpy(), distance.shape[1]), "train_id": train_ids.ravel(),
                "label": train_labels.ravel(), "distance": distance.ravel(),
            }
        return pd.DataFrame(found)

    return compare


def nearest_neighbours(
    queries: DataFrame, train: DataFrame, k: int = KNN_K, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``(id, train_id, label, distance, rank)``: the k nearest training rows per query.

    Both inputs have ``id, size, indices, values``; ``train`` also an integer
    ``label``. The result is the same for any block size.
    """
    query_blocks = max(1, -(-queries.count() // block_rows))
    train_blocks = max(1, -(-train.count() // block_rows))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    left = queries.select("id", "size", "indices", "values").withColumn("q", block(query_blocks)).withColumn("t", numbers(train_blocks))
    right = (
        train.select("id", F.col("label").cast("int").alias("label"), "size", "indices", "values")
        .withColumn("t", block(train_blocks))
        .withColumn("q", numbers(query_blocks))
    )
    pairs = query_blocks * train_blocks
    partial = (
        spread_groups(left, pairs, "q", "t").groupBy("q", "t")
        .cogroup(spread_groups(right, pairs, "q", "t").groupBy("q", "t"))
        .applyInPandas(_nearest_in_block(k), "id long, train_id long, label int, distance double")
    )
    nearest = Window.partitionBy("id").orderBy("distance", "train_id")
    return partial.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def vote(neighbours: DataFrame) -> DataFrame:
    """``(id, prediction)``: the commonest label, the smallest one of a tie."""
    votes = neighbours.groupBy("id", "label").agg(F.count("*").alias("votes"))
    return votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("votes"), F.col("label"))).alias("prediction"))


def vote_shares(neighbours: DataFrame) -> DataFrame:
    """``(id, label, share)``: share of the neighbours that have the label."""
    return (
        neighbours.groupBy("id", "label")
        .agg(F.count("*").alias("votes"))
        .withColumn("share", F.col("votes") / F.sum("votes").over(Window.partitionBy("id")))
        .select("id", "label", "share")
    )


def vote_vector(neighbours: DataFrame, classes: int) -> DataFrame:
    """``(id, prediction, probability)`` with the shares of all classes as a vector."""
    counted = neighbours.groupBy("id").agg(
        *[F.sum((F.col("label") == c).cast("double")).alias(f"c{c}") for c in range(classes)], F.count("*").alias("n")
    )
    shares = F.array(*[F.col(f"c{c}") / F.col("n") for c in range(classes)])
    return counted.select(
        "id",
        (F.array_position(shares, F.array_max(shares)) - 1).cast("double").alias("prediction"),
        array_to_vector(shares).alias("probability"),
    )
