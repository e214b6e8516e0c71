"""SimHash near-duplicates with a covering family of bit masks.

Bit i of a fingerprint gets a non-zero code phi(i) of radius + 1 bits. Mask v,
for each non-zero v, keeps the bits whose code has an odd product with v. Up to
``radius`` differing bits give at most ``radius`` equations over radius + 1
unknowns, so some v drops them all: every pair within the radius is equal under
some mask. With radius 3 there are 15 masks of about 34 bits.

Documents with one fingerprint are one row before any search. A bucket, the
fingerprints equal under one mask, is compared in one task up to ``BUCKET``
rows. A larger one is masked again, by the same rule over the bits that are
still free: each level halves the free bits, so after four levels at most 2 ** 3
different fingerprints can share a bucket, and no bucket is unbounded. Only the
links that join new fingerprints leave a bucket, never all its pairs.

Defined cases: a null or blank text has fingerprint zero and is linked like any
other; repeated rows share a component; an empty table gives no rows; a null id
is never a component's name unless nothing else is in it; other columns do not
matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillgrid.llm.batches import slices
from quillgrid.llm.components import connected_components
from quillgrid.session import materialize

# Bytes between words, the seed, and letters to lower.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

SHINGLE = 3
RADIUS = 3
BITS = 64
BUCKET = 2048
LEVELS = 4
COUNT_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one text; zero without words."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    size = min(shingle, len(words))
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist())), dtype="<u8", count=len(starts)
    )
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), COUNT_BLOCK):
        block = hashes[i:i + COUNT_BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and fingerprint (bigint), one row per document, in one pass without a shuffle."""
    kept = docs.select(*keep, F.col(text).alias("__text"))
    schema = kept.drop("__text").withColumn("fingerprint", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.fromiter((fingerprint(t.as_py()) for t in batch.column("__text")), dtype="<u8", count=batch.num_rows)
            columns = [batch.column(name) for name in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values.view("<i8"))], [*keep, "fingerprint"])

    return kept.mapInArrow(run, schema)


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit positions such that any ``radius`` of them are all dropped by some mask."""
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(len(bits))]
    return [
        sum(1 << bit for bit, code in zip(bits, codes) if (code & v).bit_count() % 2)
        for v in range(1, 2 ** (radius + 1))
    ]


def _masked(rows: DataFrame, radius: int) -> DataFrame:
    """(fingerprint, rep, mask) to (fingerprint, rep, mask, key), with the masks that follow each mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following: dict[int, np.ndarray] = {}
        for batch in batches:
            prints = np.asarray(batch.column("fingerprint")).view("<u8")
            above = np.asarray(batch.column("mask")).view("<u8")
            for value in np.unique(above):
                own = int(value)
                if own not in following:
                    free = [i for i in range(BITS) if not own >> i & 1]
                    following[own] = np.array(sorted({own | m for m in covering_masks(free, radius)}), dtype="<u8")
                chosen = np.flatnonzero(above == value)
                for mask in following[own]:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(prints[chosen].view("<i8")), batch.column("rep").take(pa.array(chosen)),
                        pa.array(np.full(len(chosen), mask, dtype="<u8").view("<i8")),
                        pa.array((prints[chosen] & mask).view("<i8")),
                    ], ["fingerprint", "rep", "mask", "key"])

    return rows.mapInArrow(run, rows.withColumn("key", F.lit(0).cast("long")).schema)


def _links(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a bucket that join its rows into the components they form; fewer links than rows."""
    open_rows, links = np.arange(len(prints)), []
    while len(open_rows):
        reached, open_rows = [int(open_rows[0])], open_rows[1:]
        while reached and len(open_rows):
            at = reached.pop()
            near = np.bitwise_count(prints[open_rows] ^ prints[at]) <= radius
            found = open_rows[near].tolist()
            links += [(at, x) for x in found]
            reached += found
            open_rows = open_rows[~near]
    return links


def _bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links in buckets of bounded size; rows come sorted, so one bucket at a time is held."""
    names = ["fingerprint", "rep", "mask", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            mask, key = np.asarray(table["mask"]), np.asarray(table["key"])
            prints, rep = np.asarray(table["fingerprint"]).view("<u8"), table["rep"].combine_chunks()
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            left, right = [], []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(mask)]):
                for x, y in _links(prints[a:b], radius) if b - a > 1 else ():
                    left.append(a + x)
                    right.append(a + y)
            if left:
                yield pa.RecordBatch.from_arrays(
                    [rep.take(pa.array(left, pa.int64())), rep.take(pa.array(right, pa.int64()))], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch.select(names)])
            table = pa.concat_tables([held, table]) if held is not None else table
            mask, key = np.asarray(table["mask"]), np.asarray(table["key"])
            changes = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))
            done = int(changes[-1]) + 1 if len(changes) else 0
            if done:
                yield from solve(table.slice(0, done))
            held = table.slice(done)
        if held is not None and held.num_rows:
            yield from solve(held)

    schema = rows.select(F.col("rep").alias("a"), F.col("rep").alias("b")).schema
    return rows.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(run, schema)


def near_links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between ``rep`` ids of different fingerprints that give all components within ``radius`` bits."""
    rows, links = prints.select("fingerprint", "rep", F.lit(0).cast("long").alias("mask")), None
    for level in range(LEVELS):
        masked = _masked(rows, radius)
        sizes = masked.groupBy("mask", "key").count().where("count > 1")
        shared = materialize(masked.join(sizes, ["mask", "key"]), "buckets")
        last = level == LEVELS - 1
        found = _bucket_links(shared if last else shared.where(F.col("count") <= bucket), radius)
        links = found if links is None else links.union(found)
        rows = shared.where(F.col("count") > bucket).select("fingerprint", "rep", "mask").distinct()
        if last or rows.isEmpty():
            return links
    return links


def near_parts(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, bucket: int = BUCKET
) -> DataFrame:
    """__id, text_hash, fingerprint and part of every document: the smallest fingerprint linked by steps of at most ``radius`` bits."""
    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("__t"))
    marked = materialize(fingerprints(texts, "__t", ("__id", "text_hash")), "prints")
    prints = materialize(marked.select("fingerprint").distinct(), "distinct-prints")
    reached = connected_components(near_links(prints.withColumn("rep", F.col("fingerprint")), radius, bucket))
    named = marked.join(reached.select(F.col("node").alias("fingerprint"), "component"), "fingerprint", "left")
    return materialize(named.select("__id", "text_hash", "fingerprint", F.coalesce("component", "fingerprint").alias("part")), "parts")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, bucket: int = BUCKET
) -> DataFrame:
    """id, fingerprint (bigint) and component_id: the smallest id linked to the document by steps of at most ``radius`` bits."""
    parts = near_parts(docs, id_col, text, radius, bucket)
    least = parts.groupBy("part").agg(F.min("__id").alias("component_id"))
    return parts.join(least, "part").select(F.col("__id").alias(id_col), "fingerprint", "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` per component: that of the smallest (id, hash of the text), a null id last."""
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("text_hash").alias("hash")))
    kept = near_parts(docs, id_col, text).groupBy("part").agg(first.alias("first")).select(F.struct("first.id", "first.hash").alias("__key"))
    # One shuffle by the key, equal also for null ids, serves the join and the choice of one of several equal rows.
    keyed = docs.withColumn("__key", F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash")))
    return keyed.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
