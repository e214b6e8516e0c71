"""Hard-negative mining by exact integer scores from a residue number system.

Vectors are scaled and floored to integers. Their inner products are found
without rounding in float32: the matrices are reduced modulo several primes,
small enough that a product of residues over all components stays under 2 ** 24,
multiplied once per prime, and the signed scores are rebuilt by Chinese
remaindering (mixed radix digits). As many primes are taken as the greatest
possible score of the two blocks needs.

Rows become blocks of at most ``BLOCK`` where they lie, without a shuffle. The
anchors, a stated query set, are grouped by hash so that a group is at most
``GROUP_ANCHORS`` rows; each group is one broadcast of a known size that meets
every block of rows. Two such passes are made: the first leaves at most ``k``
positives per anchor and block, the second, knowing the score of each positive,
at most ``k`` rows of its window per block. Only those rows are shuffled.

Defined cases: a null label, null vector, or null, infinite or NaN component
keeps a row out, as anchor and as partner; shorter vectors count as padded with
zeros; an anchor without positives, or a positive without negatives, gives no
rows; repeated rows of an anchor are one anchor, repeated partners count as often
as they occur; rows with a null id are no anchors and come last among ties;
scores beyond a long are compared exactly and returned as the nearest long; an
empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgrid.session import materialize

BLOCK = 1024
GROUP_ANCHORS = 65536
EXACT = 1 << 24
LONG = (1 << 63) - 1
SAFE = 1 << 60
NO_ID = LONG


def primes_for(width: int, bound: int) -> list[int]:
    """Descending primes whose residue products over ``width`` terms stay exact in float32, until their product passes 2 * bound + 1."""
    top = max(3, math.isqrt(EXACT // max(width, 1)))
    found, product, p = [], 1, top
    while product <= 2 * bound + 1:
        if p < 2:
            raise ValueError(f"vectors of {width} components are too wide for exact float32 products")
        if all(p % d for d in range(2, math.isqrt(p) + 1)):
            found.append(p)
            product *= p
        p -= 1
    return found


def residue_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of two float64 matrices of integers: int64, or Python integers where a score might not fit."""
    def greatest(m: np.ndarray) -> int:
        return int(np.abs(m).max(initial=0.0))

    bound = a.shape[1] * greatest(a) * greatest(b)
    primes = primes_for(a.shape[1], bound)
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        product = np.mod(a, p).astype(np.float32) @ np.mod(b, p).astype(np.float32).T
        digit = product.astype(np.int64) % p
        for q, earlier in zip(primes[:k], digits):
            digit = (digit - earlier) * pow(q, -1, p) % p
        digits.append(digit)
    modulus = math.prod(primes)
    total = np.zeros((len(a), len(b)), np.int64 if modulus < 1 << 62 else object)
    for p, digit in zip(primes[::-1], digits[::-1]):
        total = total * p + digit
    return np.where(total > modulus // 2, total - modulus, total)


def first_of(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest allowed scores of each row, ties by smaller id."""
    if scores.dtype == object:
        chosen = [(r, c) for r in range(len(scores)) for c in sorted(np.flatnonzero(allowed[r]), key=lambda x: (-scores[r, x], ids[x]))[:k]]
        pairs = np.array(chosen, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]
    lowest = np.iinfo(np.int64).min
    held = np.where(allowed, scores, lowest)
    if held.shape[1] > k:
        edge = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        allowed = allowed & (held >= edge[:, None])
    row, column = np.nonzero(allowed)
    order = np.lexsort((ids[column], -held[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _packed(rows: DataFrame, id_col: str) -> DataFrame:
    """Blocks of rows as (rows, width, ids, labels, values, more) in bytes; values are float64 integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                vectors = part.column("values")
                lengths = np.diff(vectors.offsets.to_numpy())
                width = max(1, int(lengths.max(initial=0)))
                flat = vectors.flatten().to_numpy(zero_copy_only=False)
                values = np.zeros((part.num_rows, width))
                values[np.repeat(np.arange(part.num_rows), lengths), np.concatenate([np.arange(n) for n in lengths] or [[]]).astype(int)] = flat
                ids = part.column(id_col).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (part.num_rows, width, ids.tobytes(), part.column("label").to_numpy().astype("<i8").tobytes(), values.astype("<f8").tobytes())]
                    + [pa.array([part.column("more").to_pylist()], pa.list_(part.column("more").type))],
                    ["rows", "width", "ids", "labels", "values", "more"])

    kind = rows.schema["more"].dataType.simpleString()
    return rows.mapInArrow(run, f"rows long, width long, ids binary, labels binary, values binary, more array<{kind}>")


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shape = row["rows"], row["width"]
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), np.frombuffer(row["values"], "<f8").reshape(shape)


def _scored(row: dict) -> tuple:
    a_ids, a_labels, a = _unpack({k.removeprefix("a_"): v for k, v in row.items() if k.startswith("a_")})
    b_ids, b_labels, b = _unpack(row)
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    return a_ids, a_labels, b_ids, b_labels, residue_scores(a, b)


def _long(score) -> int:
    return max(-LONG - 1, min(LONG, int(score)))


def _met(blocks: DataFrame, anchors: DataFrame, k: int, windows: bool, low: int, high: int) -> DataFrame:
    """Rows of every block that are among the first of an anchor (or of an anchor's windows) in that block."""

    def positives(row: dict) -> Iterator[list]:
        a_ids, a_labels, b_ids, b_labels, scores = _scored(row)
        fits = (b_labels[None, :] == a_labels[:, None]) & (b_ids[None, :] != a_ids[:, None])
        for r, c in zip(*first_of(scores, b_ids, fits, k)):
            yield [int(a_ids[r]), row["a_more"][r], None, None, None, None, int(b_ids[c]), _long(scores[r, c]), str(scores[r, c])]

    def negatives(row: dict) -> Iterator[list]:
        a_ids, a_labels, b_ids, b_labels, scores = _scored(row)
        asked = [(r, x) for r, found in enumerate(row["a_more"]) for x in found]
        for start in range(0, len(asked), BLOCK):
            part = asked[start:start + BLOCK]
            at = np.array([r for r, _ in part])
            line, p = scores[at], np.array([int(x["exact_positive"]) for _, x in part], object)[:, None]
            small = line.dtype != object and max(int(np.abs(line).max(initial=0)), int(np.abs(p).max())) < SAFE // max(low, high)
            line, p = (line, p.astype(np.int64)) if small else (line.astype(object), p)
            fits = (b_labels[None, :] != a_labels[at][:, None]) & (low * p <= 100 * line).astype(bool) & (100 * line <= high * p).astype(bool)
            for r, c in zip(*first_of(line, b_ids, fits, k)):
                x = part[r][1]
                yield [int(a_ids[at[r]]), x["anchor_key"], x["positive_id"], x["positive_no"], x["positive_score"], x["exact_positive"],
                       int(b_ids[c]), _long(line[r, c]), str(line[r, c])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                out = list((negatives if windows else positives)(row))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), SCORED.types)], SCORED.names)

    sent = F.broadcast(anchors.select(*(F.col(c).alias(f"a_{c}") for c in anchors.columns)))
    return blocks.drop("more").crossJoin(sent).mapInArrow(
        run, "anchor_id long, anchor_key long, positive_id long, positive_no int, positive_score long, exact_positive string, partner_id long, score long, exact string")


SCORED = pa.schema([
    ("anchor_id", pa.int64()), ("anchor_key", pa.int64()), ("positive_id", pa.int64()), ("positive_no", pa.int32()), ("positive_score", pa.int64()),
    ("exact_positive", pa.string()), ("partner_id", pa.int64()), ("score", pa.int64()), ("exact", pa.string()),
])


def _first(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """The k first rows of each group with their rank; a group has at most k rows per block."""
    above, below = F.col("score") == LONG, F.col("score") == -LONG - 1
    digits = F.length("exact")
    order = Window.partitionBy(*by).orderBy(
        F.desc("score"), F.desc(F.when(above, digits).when(below, -digits)), F.desc(F.when(above, F.col("exact"))), F.when(below, F.col("exact")), "partner_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(rows: DataFrame, id_col: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(id, label, values) of the rows that take part; values are integers held as doubles."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    whole = rows.select(F.col(id_col).cast("long").alias(id_col), label.cast("long").alias("label"), values.alias("values")).where(
        F.col("label").isNotNull() & F.col("values").isNotNull()
        & F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # floor() of Spark gives a long; a multiple of one half beyond 2 ** 52 is whole already.
    floor = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    return whole.withColumn("values", F.transform("values", lambda x: floor(x * float(scale))))


def mine(
    rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: Column | None = None, anchor: Column | None = None,
    k_positive: int = 5, k_negative: int = 5, low: int = 80, high: int = 100, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores of the hard negatives of every anchor and positive.

    A negative's score is within ``low`` and ``high`` per cent of the positive's.
    ``anchor`` says which rows are anchors: by default those whose id is divisible by 100.
    """
    anchor = F.col(id_col) % 100 == 0 if anchor is None else anchor
    used = materialize(usable(rows, id_col, vector, F.col("label") if label is None else label, scale), "vectors")
    key = F.xxhash64("label", "values")
    chosen = materialize(used.where(anchor & F.col(id_col).isNotNull()).withColumn("more", key).dropDuplicates([id_col, "more"]), "anchors")
    groups = max(1, math.ceil(chosen.count() / GROUP_ANCHORS))
    blocks = materialize(_packed(used.withColumn("more", F.lit(0)), id_col), "blocks")

    def each_group(frame: DataFrame, windows: bool, k: int) -> DataFrame:
        parts = []
        for g in range(groups):
            part = frame.where(F.pmod(F.xxhash64(id_col), F.lit(groups)) == g) if groups > 1 else frame
            parts.append(_met(blocks, _packed(part, id_col), k, windows, low, high))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.union(part)
        return whole

    found = _first(each_group(chosen, False, k_positive), k_positive, "anchor_id", "anchor_key")
    positives = materialize(found.groupBy("anchor_id", "anchor_key").agg(F.collect_list(F.struct(
        "anchor_key", F.col("partner_id").alias("positive_id"), F.col("rank").alias("positive_no"), F.col("score").alias("positive_score"), F.col("exact").alias("exact_positive"),
    )).alias("list")), "positives")
    with_positives = chosen.withColumnRenamed("more", "anchor_key").join(
        positives.withColumnRenamed("anchor_id", id_col), [id_col, "anchor_key"]).select(id_col, "label", "values", F.col("list").alias("more"))
    negatives = _first(each_group(with_positives, True, k_negative), k_negative, "anchor_id", "anchor_key", "positive_no")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return negatives.select(
        "anchor_id", known("positive_id").alias("positive_id"), "rank", known("partner_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
