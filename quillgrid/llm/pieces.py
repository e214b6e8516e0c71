"""Encoding and decoding with the pieces of a SentencePiece model.

An Aho-Corasick automaton over all pieces reads a text once. At each position it
gives the piece that ends there and, along its output links, the shorter ones;
each relaxes the best score up to that position (Viterbi), so the segmentation
has the greatest sum of piece scores, the longer last piece among equals. A
character that is no piece by itself may also become the bytes of its UTF-8 form
at a score below that of every piece.

Spaces are written as the model's space mark and one is put in front, as the
model expects; a mark that is in the text itself becomes bytes, and nothing is
normalised, so decoding gives back exactly the text that was encoded.

No piece has a mark behind another character, so a text is cut before each run
of spaces, and at characters no piece has; each part is segmented once per
worker and kept in a bounded table. Long texts are read in slices that end before
a space, so where a slice ends never changes a segmentation; a run without a
space is one slice whatever its length, at twelve bytes a character.

Defined cases: null and empty texts have no ids and decode to the empty text;
repeated rows are encoded alike; an empty table gives no rows; other columns do
not matter.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, MutableSequence

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from quillgrid.llm.batches import keep_one, slices

# Fixed value: how SentencePiece marks a space.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
SLICE_CHARS = 1 << 20
PARTS_HELD = 300_000
LONGEST_HELD = 64
WORD_END = re.compile("[^ ] ")


def default_model() -> str:
    """Where the public 32,000-piece model is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Parts(dict):
    """Ids of a part as int32 bytes, worked out when first asked for."""

    def __init__(self, coder: PieceCoder):
        self.coder = coder

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.coder.segment(part), dtype="<i4").tobytes()
        if len(part) <= LONGEST_HELD:
            self[part] = ids
        return ids


class PieceCoder:
    def __init__(self, model: bytes, held: int = PARTS_HELD):
        source = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.held = held
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        self.byte_ids: dict[int, int] = {}
        decoded: list[bytes] = []
        self.sizes: list[int] = []
        scores, alphabet, cut_at_spaces = [0.0], set(), True
        for i in range(source.get_piece_size()):
            piece = source.id_to_piece(i)
            self.sizes.append(len(piece))
            if source.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                decoded.append(bytes([value]))
            elif source.is_control(i) or source.is_unknown(i) or source.is_unused(i) or not piece:
                decoded.append(b"")
            else:
                score = source.get_score(i)
                self.automaton.add_word(piece, (i, len(piece), score))
                scores.append(score)
                alphabet.update(piece)
                if len(piece) == 1:
                    self.single.add(piece)
                if MARK in piece[1:] and piece.strip(MARK):
                    cut_at_spaces = False
                decoded.append(piece.replace(MARK, " ").encode())
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no pieces for single bytes, so unknown characters could not be decoded")
        self.automaton.make_automaton()
        self.lengths = np.fromiter(map(len, decoded), np.int64, len(decoded))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(decoded), np.uint8)
        self.unknown = min(scores) - UNKNOWN_PENALTY
        alone = re.escape("".join(sorted(set("\n\r\t") - alphabet)) + MARK)
        self.cuts = cut_at_spaces
        self.part = re.compile(f"[{alone}]| *[^ {alone}]+| +" if cut_at_spaces else f"{MARK}|[^{MARK}]+")
        self.parts = _Parts(self)

    def _bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]

    def segment(self, part: str) -> list[int]:
        """Ids of one part of a text, spaces not yet marked."""
        if part == MARK:
            return self._bytes_of(part)
        text = part.replace(" ", MARK)
        n, single, unknown = len(text), self.single, self.unknown
        best: MutableSequence[float] = [-float("inf")] * (n + 1) if n <= LONGEST_HELD else array("d", [-float("inf")]) * (n + 1)
        piece: MutableSequence[int] = [-1] * (n + 1) if n <= LONGEST_HELD else array("i", [-1]) * (n + 1)
        best[0] = 0.0
        reached = 0

        def relax_unknown(until: int) -> None:
            for at in range(reached, until):
                if text[at] not in single and best[at] + unknown > best[at + 1]:
                    best[at + 1], piece[at + 1] = best[at] + unknown, -1

        for last, (i, length, score) in self.automaton.iter(text):
            end = last + 1
            if end > reached:
                relax_unknown(end)
                reached = end
            total = best[end - length] + score
            if total > best[end]:
                best[end], piece[end] = total, i
        relax_unknown(n)
        ids: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
                at -= self.sizes[piece[at]]
            else:
                at -= 1
                ids += self._bytes_of(text[at])[::-1]
        return ids[::-1]

    def _slices(self, text: str) -> Iterator[str]:
        """Slices of at least SLICE_CHARS that end before a run of spaces; without one, the rest at once."""
        at = 0
        while self.cuts and len(text) - at > SLICE_CHARS and (found := WORD_END.search(text, at + SLICE_CHARS)):
            yield text[at:found.start() + 1]
            at = found.start() + 1
        yield text[at:]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<i4")
        found = []
        for piece in self._slices(" " + text):
            if len(self.parts) > self.held:
                self.parts.clear()
            found.append(b"".join(map(self.parts.__getitem__, self.part.findall(piece))))
        return np.frombuffer(b"".join(found), dtype="<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; bytes that are no UTF-8 are replaced, the space in front is taken off."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        text = self.bytes[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _coder(model: bytes) -> PieceCoder:
    return keep_one(("pieces", model), lambda: PieceCoder(model))


def _model_bytes(model_path: str | None) -> bytes:
    with open(model_path or default_model(), "rb") as file:
        return file.read()


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def encode(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model_path: str | None = None, decoded: bool = False
) -> DataFrame:
    """``keep`` and input_ids of every document; with ``decoded`` also the text that the ids give.

    The model, whose size does not depend on the data, is broadcast; no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_model_bytes(model_path))
    kept = docs.select(*keep, F.col(text).alias("__text"))
    schema = kept.drop("__text").withColumn("input_ids", F.array().cast("array<int>"))
    schema = (schema.withColumn("decoded", F.lit("")) if decoded else schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value)
        for batch in slices(batches):
            ids = [coder.encode(t.as_py()) for t in batch.column("__text")]
            columns = [*(batch.column(c) for c in keep), _lists(ids)]
            if decoded:
                columns.append(pa.array([coder.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return kept.mapInArrow(run, schema)


def decode(
    encoded: DataFrame, ids: str = "input_ids", keep: tuple[str, ...] = ("doc_id",), model_path: str | None = None
) -> DataFrame:
    """``keep`` and decoded text of every row of ids; null ids give the empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(_model_bytes(model_path))
    kept = encoded.select(*keep, F.col(ids).alias("__ids"))
    schema = kept.drop("__ids").withColumn("decoded", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value)
        for batch in slices(batches):
            texts = [coder.decode(np.array(x.as_py() or [], dtype=np.int64)) for x in batch.column("__ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], schema.names)

    return kept.mapInArrow(run, schema)
