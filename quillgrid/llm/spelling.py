"""Spelling variants: words that differ by one letter, and the frequent form of each.

Words within one inserted, deleted or replaced letter have letter multisets, seen
as binary vectors of (letter, occurrence), at a Hamming distance of at most two:
exactly one if a letter is more, two if one is replaced. PartEnum signatures find
all such pairs: the vector is parted by a hash of its dimensions, and every choice
of all parts but as many as may differ is a signature. Equal lengths use four
parts and leave out two, lengths one apart use two parts and leave out one. The
length and one half of the word, of which an edit leaves the other unchanged, go
into the key of the equi-join as well, so keys shared by many words are rare;
the join verifies each pair by its edit distance.

``n_near`` counts every near word. The form is the near word of largest count if
that is at least twice the word's own; forms lead to the root by pointer
doubling, in rounds that grow with the logarithm of the longest chain.

Defined cases: null and blank texts have no words; repeated rows count as often
as they occur; a row with a null id has no letter deleted; ties go to the
smallest word in code-point order; an empty table gives no rows; other columns do
not matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillgrid.session import materialize

# Runs of letters, and the letters that are lowered.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIN_LETTERS = 5
MIN_COUNT = 3
NOISE = 97
RATIO = 2
# Parts and how many of them may differ, for equal lengths and for lengths one apart.
SAME, APART = (4, 2), (2, 1)


def noisy_word(run: Column, doc_id: Column) -> Column:
    """The run, without one letter if NOISE divides the checksum of id and run."""
    checksum = F.crc32(F.encode(F.concat(doc_id.cast("string"), F.lit(":"), run), "UTF-8"))
    at = (checksum % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(checksum % NOISE == 0, shorter).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) over all texts; counted where the words are before they are shuffled."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run"))
    words = runs.where(F.length("run") >= min_letters).select(noisy_word(F.col("run"), F.col("id")).alias("word"))
    return words.where(F.length("word") >= min_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def part_hashes(words: list[str], parts: int) -> np.ndarray:
    """One hash for the dimensions of each word that fall into each part, whatever their order."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    ordered = np.sort(np.repeat(np.arange(len(words)), lengths) << 21 | letters)
    at = np.arange(len(ordered))
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    occurrence = at - np.maximum.accumulate(np.where(first, at, 0))
    dimension = _mixed((ordered & 0x1FFFFF) << 32 | occurrence)
    out = np.zeros((len(words), parts), np.uint64)
    np.add.at(out, (ordered >> 21, (dimension % np.uint64(parts)).astype(np.int64)), _mixed(dimension + np.uint64(1)))
    return out


def signatures(words: list[str], parts: int, differ: int) -> np.ndarray:
    """A row per word: one signature for each choice of ``differ`` parts to leave out."""
    hashes = part_hashes(words, parts)
    columns = []
    for number, left_out in enumerate(itertools.combinations(range(parts), differ)):
        total = np.full(len(words), number, np.uint64)
        for j in sorted(set(range(parts)) - set(left_out)):
            total = _mixed(total ^ hashes[:, j])
        columns.append(total)
    return np.stack(columns, axis=1).view(np.int64)


def with_signatures(words: DataFrame) -> DataFrame:
    """(word, n, same, apart): the signatures for equal lengths and for lengths one apart."""

    def lists(values: np.ndarray) -> pa.Array:
        offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), lists(signatures(found, *SAME)), lists(signatures(found, *APART))], ["word", "n", "same", "apart"])

    return words.mapInArrow(run, "word string, n long, same array<bigint>, apart array<bigint>")


def _keyed(signed: DataFrame, column: str, length: Column, name: str) -> DataFrame:
    """A row per key: a signature, the length of the shorter word of a pair, and one half of the word.

    An edit lies in the first half or in the rest, so a pair agrees in the other:
    in the first half of the shorter word, or in what follows it.
    """
    half = F.floor(length / 2).cast("int")
    halves = F.array(F.xxhash64(F.lit(0), length, F.left(F.col("word"), half)), F.xxhash64(F.lit(1), length, F.right(F.col("word"), length - half)))
    return signed.select("word", "n", F.explode(column).alias("signature"), halves.alias("halves")).select(
        F.col("word").alias(name), F.col("n").alias(f"n_{name}"), F.explode(F.transform("halves", lambda h: F.xxhash64("signature", h))).alias("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), once for each two words one edit apart; takes (word, n)."""
    signed = materialize(with_signatures(words), "signatures")
    near = F.levenshtein("a", "b", 1) == 1
    length = F.length("word")
    one = _keyed(signed, "same", length, "a")
    other = one.select(F.col("a").alias("b"), F.col("n_a").alias("n_b"), "key")
    same = one.join(other, (one["key"] == other["key"]) & (F.col("a") < F.col("b")) & near)
    shorter, longer = _keyed(signed, "apart", length, "a"), _keyed(signed, "apart", length - 1, "b")
    apart = shorter.join(longer, (shorter["key"] == longer["key"]) & (F.length("a") + 1 == F.length("b")) & near)
    return same.select("a", "n_a", "b", "n_b").union(apart.select("a", "n_a", "b", "n_b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last; counts grow along a chain, so it ends."""
    current = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        following = materialize(current.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        current = following.select("word", "root")
        if following.where("moved").isEmpty():
            return current


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of (word, n)."""
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(
        pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near"))).alias("best"))
    strong = -F.col("best.order") >= ratio * F.col("n")
    formed = materialize(best.select("word", "n_near", F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.order")).alias("form_n")), "forms")
    ends = roots(formed.where(F.col("form").isNotNull()))
    return words.join(formed, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Count the words of all texts and group their variants."""
    return group_variants(materialize(word_counts(docs, id_col, text), "words"))
