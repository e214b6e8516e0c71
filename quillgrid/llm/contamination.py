"""Benchmark decontamination by winnowing.

Of every ``w`` consecutive k-grams the one with the least hash, the last of
equals, is kept as a fingerprint. Two texts that share ``k + w - 1`` words share
the fingerprint of that span, so with k = 5 and w = 9 every shared window of 13
words leaves a common fingerprint. An item of fewer words is one window of its
own length, winnowed with k and w that add up to that length.

Fingerprints of a document that are among the benchmark's are extended to the
windows around them, and each of those is looked up and compared word by word:
hashes only choose where to look. Each document is one pass without a shuffle.
The benchmark's windows are sent to the tasks in blocks of at most
``BLOCK_CHARS`` characters of item text; a benchmark of more blocks is passed
over once per block and the hits of a document are joined by its id and text.

Defined cases: a null or wordless document has no words, hits or items; a null or
wordless item never occurs; equal items all occur; rows with one id and one text
get the same result; empty tables give no hits or no rows; other columns do not
matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillgrid.llm.batches import keep_one, slices
from quillgrid.session import materialize

# What a word is (after A-Z became a-z), and how long a window is.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WINDOW = 13
MIN_SHARE = 20

GRAM = 5
BLOCK_CHARS = 8_000_000
WORDS_HELD = 300_000
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))


class WordHashes:
    """64-bit hashes of words, with a bounded table of words seen."""

    def __init__(self, held: int = WORDS_HELD):
        self.held, self.seen = held, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.held:
            seen.clear()
        digest = xxhash.xxh64_intdigest
        for word in set(words).difference(seen):
            seen[word] = digest(word)
        return np.fromiter((seen[w] for w in words), dtype=np.uint64, count=len(words))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = max(len(words) - k + 1, 0)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total = total * MULTIPLIER + words[j:j + n]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash in each of the windows of ``w`` grams, the last of equals, each once."""
    n = len(grams) - w + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        other = grams[j:j + n]
        better = other <= least
        least[better] = other[better]
        at[better] = np.arange(j, j + n)[better]
    return np.unique(at)


def gram_and_span(length: int) -> tuple[int, int]:
    k = min(GRAM, length)
    return k, length - k + 1


class Windows:
    """Windows of benchmark items by length, with their fingerprints."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        hashes, self.by_length = WordHashes(), {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            length = min(window, len(words))
            k, w = gram_and_span(length)
            windows, prints = self.by_length.setdefault(length, ({}, set()))
            for i in range(len(words) - length + 1):
                windows.setdefault(b" ".join(words[i:i + length]), set()).add(item_id)
            grams = gram_hashes(hashes(words), k)
            prints.update(grams[winnow(grams, w)].tolist())
        self.by_length = {
            n: (windows, np.array(sorted(prints), dtype=np.uint64)) for n, (windows, prints) in self.by_length.items()
        }

    def hits(self, words: list[bytes], hashes: WordHashes) -> tuple[list[tuple[int, int]], set]:
        """Spans of words in occurrences of a window, joined where they meet, and the items that occur."""
        spans, items = [], set()
        values = None
        for length, (windows, prints) in self.by_length.items():
            if len(words) < length:
                continue
            k, w = gram_and_span(length)
            values = hashes(words) if values is None else values
            grams = gram_hashes(values, k)
            at = winnow(grams, w)
            found = np.searchsorted(prints, grams[at])
            at = at[prints[np.minimum(found, len(prints) - 1)] == grams[at]]
            if not len(at):
                continue
            starts = np.unique((at[:, None] - np.arange(w)[None, :]).ravel())
            for start in starts[(starts >= 0) & (starts + length <= len(words))].tolist():
                owners = windows.get(b" ".join(words[start:start + length]))
                if owners:
                    spans.append((start, start + length))
                    items |= owners
        return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((start, end))
    return merged


def _probe(docs: DataFrame, windows: Windows, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, n_words, spans [start, end, start, ...] and items (as text) of every document."""
    kept = docs.select(*keep, F.col(text).alias("__text"))
    extra = {"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<int>"), "items": F.array().cast("array<string>")}
    schema = kept.drop("__text").withColumns(extra).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = keep_one("words", WordHashes)
        for batch in slices(batches):
            counts, spans, items = [], [], []
            for value in batch.column("__text"):
                words = words_of(value.as_py())
                here, owners = windows.hits(words, hashes)
                counts.append(len(words))
                spans.append([x for span in here for x in span])
                items.append(sorted(map(str, owners)))
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in keep), pa.array(counts, pa.int64()),
                pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())),
            ], [*keep, "n_words", "spans", "items"])

    return kept.mapInArrow(run, schema)


def find_hits(
    docs: DataFrame, bench: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``keep``, n_words, spans and items per document; spans may overlap if the benchmark has several blocks."""
    usable = bench.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(
        F.col(item_id).alias("item"), F.col(item_text).alias("text")
    )
    chars = usable.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    if blocks == 1:
        return _probe(docs, Windows([tuple(r) for r in usable.collect()]), text, keep)
    keyed = docs.select(*keep, text, F.struct(*keep, F.xxhash64(text), F.length(text)).alias("__key"))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    found = []
    for b in range(blocks):
        windows = Windows([tuple(r) for r in usable.where(block == b).collect()])
        hit = _probe(keyed, windows, text, ("__key",)).where(F.size("items") > 0).select("__key", "spans", "items")
        found.append(materialize(hit.distinct(), "hits"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    hits = hits.groupBy("__key").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    counted = _probe(keyed, Windows([]), text, (*keep, "__key")).drop("spans", "items")
    key = counted["__key"]
    joined = counted.join(hits.withColumnRenamed("__key", "__hit"), key.eqNullSafe(F.col("__hit")), "left").drop("__key", "__hit")
    return joined.withColumns({c: F.coalesce(c, F.array().cast(joined.schema[c].dataType)) for c in ("spans", "items")})


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), **settings) -> DataFrame:
    """``keep``, n_words, n_hit, items and contaminated: at least one word in ``MIN_SHARE`` is hit."""
    found = find_hits(docs, bench, text, keep, **settings)
    # Spans in order of start; what each adds beyond the furthest end so far.
    pairs = F.array_sort(F.transform(
        F.expr("sequence(0, size(spans) - 2, 2)"), lambda i: F.struct(F.get("spans", i).alias("a"), F.get("spans", i + 1).alias("b"))
    ))
    covered = F.aggregate(
        pairs, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("n"),
            F.greatest(s["end"], x["b"]).alias("end")),
    )
    n_hit = F.when(F.size("spans") > 0, covered["n"]).otherwise(F.lit(0).cast("long"))
    return found.select(*keep, "n_words", n_hit.alias("n_hit"), "items").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (MIN_SHARE * F.col("n_hit") >= F.col("n_words"))
    )
