"""Language identification by a bidirectional recurrent network over bytes.

Two gated recurrent layers read the bytes of a word, one forwards and one
backwards, and a softmax over both states labels every byte with a language. A
document's probabilities are the mean over all its bytes in words that hold a
letter. The state starts anew at white space, so what a word says does not
depend on its neighbours: each task scores a distinct word once and keeps a
bounded table of words it has seen. The whole text is always read.

The network is trained with numpy on the driver by backpropagation through
time. It learns from the words of at most about ``TRAIN_DOCS`` labelled
documents per language, chosen by a hash of their id, and of those words from
the ``TRAIN_WORDS`` most frequent (language, word) pairs; both bounds are
parameters. The model that is sent to the tasks has a fixed size.

Defined cases: a null text or one without a letter is ``und`` with score 0; with
nothing to learn from, all documents are; ties go to the first language in
order of name; repeated rows are predicted alike; a null id is held out of
training but not counted as held out; other columns do not matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from quillgrid.llm.batches import keep_one, slices

TRAIN_DOCS = 300
TRAIN_WORDS = 60_000
HIDDEN = 16
STEPS = 500
BATCH = 256
LEARNING_RATE = 0.02
SEGMENT = 24
FOLDS = 5
UNKNOWN = "und"
WORDS_HELD = 300_000
SLICE_CHARS = 1 << 20
SCORED_AT_ONCE = 2048
SCORED_TOGETHER = 30_000
WORDS_WAITING = 500_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


@dataclass
class ByteTagger:
    """Parameters of the network; direction 0 reads forwards, 1 backwards."""

    languages: list[str]
    table: np.ndarray    # [2, 256, 3H] what a byte adds to each gate
    inner: np.ndarray    # [2, H, 3H]
    bias: np.ndarray     # [2, 3H]
    out: np.ndarray      # [2H, languages]
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, rng: np.random.Generator) -> ByteTagger:
        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        n = len(languages)
        return cls(
            languages, draw(2, 256, 3 * hidden, scale=0.3), draw(2, hidden, 3 * hidden, scale=hidden ** -0.5),
            np.zeros((2, 3 * hidden), np.float32), draw(2 * hidden, n, scale=0.3), np.zeros(n, np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.bias, self.out, self.out_bias]

    def _direction(self, d: int, codes: np.ndarray, keep: list | None) -> np.ndarray:
        """States [T, B, H] of one direction over words of equal length."""
        size, hidden = codes.shape[1], self.inner.shape[1]
        state = np.zeros((codes.shape[0], hidden), np.float32)
        states = np.empty((size, codes.shape[0], hidden), np.float32)
        for t in range(size) if d == 0 else range(size - 1, -1, -1):
            x, h = self.table[d][codes[:, t]], state @ self.inner[d] + self.bias[d]
            gates = _sigmoid(x[:, :2 * hidden] + h[:, :2 * hidden])
            z, r = gates[:, :hidden], gates[:, hidden:]
            new = np.tanh(x[:, 2 * hidden:] + r * h[:, 2 * hidden:])
            if keep is not None:
                keep.append((t, state, z, r, new, h[:, 2 * hidden:]))
            state = new + z * (state - new)
            states[t] = state
        return states

    def label(self, codes: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States [T, B, 2H] and probabilities [T, B, languages] of words of equal length, [B, T] byte values."""
        states = np.concatenate([self._direction(d, codes, keep[d] if keep else None) for d in (0, 1)], axis=2)
        logits = states @ self.out + self.out_bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        return states, logits / logits.sum(axis=2, keepdims=True)

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
        keep: tuple[list, list] = ([], [])
        states, p = self.label(codes, keep)
        size, batch, _ = p.shape
        hidden = self.inner.shape[1]
        rows = np.arange(batch)
        loss = -float(np.log(p[:, rows, target] + 1e-12).mean())
        p[:, rows, target] -= 1.0
        p /= size * batch
        g_table, g_inner, g_bias = (np.zeros_like(x) for x in (self.table, self.inner, self.bias))
        g_out = np.einsum("tbh,tbl->hl", states, p)
        g_states = p @ self.out.T
        for d in (0, 1):
            flow = np.zeros((batch, hidden), np.float32)
            for t, state, z, r, new, h in reversed(keep[d]):
                flow = flow + g_states[t, :, d * hidden:(d + 1) * hidden]
                d_new = flow * (1 - z) * (1 - new * new)
                d_z = flow * (state - new) * z * (1 - z)
                d_r = d_new * h * r * (1 - r)
                to_x = np.concatenate([d_z, d_r, d_new], axis=1)
                to_h = np.concatenate([d_z, d_r, d_new * r], axis=1)
                np.add.at(g_table[d], codes[:, t], to_x)
                g_inner[d] += state.T @ to_h
                g_bias[d] += to_h.sum(axis=0)
                flow = flow * z + to_h @ self.inner[d].T
        return loss, [g_table, g_inner, g_bias, g_out, p.sum(axis=(0, 1))]


def train_tagger(
    words: list[bytes], languages: list[str], weights: list[float], hidden: int = HIDDEN, steps: int = STEPS,
    batch: int = BATCH, rate: float = LEARNING_RATE, seed: int = 0,
) -> ByteTagger:
    """Fit a tagger on labelled words; ``weights`` are counts. Languages weigh the same, whatever their share."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    index = {name: i for i, name in enumerate(names)}
    model = ByteTagger.fresh(names, hidden, rng)
    label = np.array([index[x] for x in languages])
    weight = np.array(weights, dtype=np.float64)
    weight /= np.bincount(label, weights=weight)[label]
    cut = [w[:SEGMENT] for w in words]
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(cut):
        by_length.setdefault(len(w), []).append(i)
    lengths = sorted(by_length)
    groups = {}
    for n in lengths:
        at = np.array(by_length[n])
        groups[n] = np.frombuffer(b"".join(cut[i] for i in at), np.uint8).reshape(-1, n), label[at], weight[at] / weight[at].sum()
    share = np.array([weight[by_length[n]].sum() * n for n in lengths])
    parameters = model.parameters()
    first, second = ([np.zeros_like(x) for x in parameters] for _ in range(2))
    for step in range(1, steps + 1):
        codes, target, p = groups[int(rng.choice(lengths, p=share / share.sum()))]
        chosen = rng.choice(len(codes), size=batch, p=p)
        _, gradients = model.gradients(codes[chosen], target[chosen])
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in gradients)))
        now = rate * min(1.0, 2.0 * (1.0 - step / (steps + 1)))
        for x, g, m, v in zip(parameters, gradients, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return model


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def training_words(docs: DataFrame, id_col: str, text: str, lang: str, n_docs: int = TRAIN_DOCS, n_words: int = TRAIN_WORDS) -> list:
    """The most frequent (language, word) pairs of a bounded, hash-chosen part of the documents outside the held-out fold."""
    labelled = docs.where((remainder(id_col) != 0) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = labelled.groupBy(F.col(lang).alias("lang")).count().collect()
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("train")), F.lit(1_000_000_007)) / 1_000_000_007
    chosen = F.lit(False)
    for row in counts:
        chosen = chosen | ((F.col(lang) == row["lang"]) & (draw < n_docs / row["count"]))
    split = F.explode(F.split(text, r"[\x20\x09-\x0D]+")).alias("word")
    words = labelled.where(chosen).select(F.col(lang).alias("lang"), split).where(F.col("word").rlike(r"\p{L}"))
    return words.groupBy("lang", "word").count().orderBy(F.desc("count"), "lang", "word").limit(n_words).collect()


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", **settings) -> ByteTagger | None:
    """A tagger for the languages of ``docs``, or None if no labelled word is outside the held-out fold."""
    rows = training_words(docs, id_col, text, lang)
    if not rows:
        return None
    return train_tagger([r["word"].encode() for r in rows], [r["lang"] for r in rows], [r["count"] for r in rows], **settings)


def _slices(text: str) -> Iterator[bytes]:
    """The text in parts of bounded size, cut at white space where there is any."""
    start = 0
    while len(text) - start > SLICE_CHARS:
        end = start + SLICE_CHARS
        cut = max(text.rfind(" ", start, end), text.rfind("\n", start, end))
        end = cut + 1 if cut > start else end
        yield text[start:end].encode("utf-8", "replace")
        start = end
    yield text[start:].encode("utf-8", "replace")


class WordScores:
    """Summed label probabilities and labelled bytes of words, in a bounded table that is emptied when full."""

    def __init__(self, model: ByteTagger, held: int = WORDS_HELD):
        self.model, self.held = model, held
        self._empty()

    def _empty(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages) + 1), np.float64)

    def _score(self, words: list[bytes], first: int) -> None:
        while first + len(words) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        by_length: dict[int, tuple[list[bytes], list[int]]] = {}
        for i, word in enumerate(words):
            letters = word.decode("utf-8", "ignore")
            if not (letters.isalpha() or any(map(str.isalpha, letters))):
                continue
            for k in range(0, len(word), SEGMENT):
                segment = word[k:k + SEGMENT]
                segments, owners = by_length.setdefault(len(segment), ([], []))
                segments.append(segment)
                owners.append(first + i)
        for n, (segments, owners) in by_length.items():
            for k in range(0, len(segments), SCORED_AT_ONCE):
                part = segments[k:k + SCORED_AT_ONCE]
                codes = np.frombuffer(b"".join(part), np.uint8).reshape(-1, n)
                _, p = self.model.label(codes)
                own = np.array(owners[k:k + SCORED_AT_ONCE])
                np.add.at(self.scores, own, np.concatenate([p.sum(axis=0), np.full((len(part), 1), n)], axis=1))

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """Sums over all words of each text. New words are scored many at a time, across texts."""
        result = np.zeros((len(texts), len(self.model.languages) + 1))
        waiting: list[tuple[int, np.ndarray]] = []
        fresh: list[bytes] = []
        held = 0

        def score() -> None:
            self._score(fresh, len(self.ids) - len(fresh))
            for at, words in waiting:
                result[at] += self.scores[words].sum(axis=0)
            waiting.clear()
            fresh.clear()
            if len(self.ids) > self.held:
                self._empty()

        for at, text in enumerate(texts):
            for part in _slices(text or ""):
                words = part.split()
                ids = self.ids
                new = [w for w in set(words) if w not in ids]
                ids.update(zip(new, range(len(ids), len(ids) + len(new))))
                fresh += new
                waiting.append((at, np.fromiter(map(ids.__getitem__, words), np.int32, len(words))))
                held += len(words)
                if len(fresh) > SCORED_TOGETHER or held > WORDS_WAITING:
                    score()
                    held = 0
        score()
        return result


def predict(docs: DataFrame, model: ByteTagger | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score of every document; one pass, no shuffle."""
    kept = docs.select(*keep, F.col(text).alias("__text"))
    schema = kept.drop("__text").withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)}).schema

    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model)) if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = keep_one(("language", sent.value), lambda: WordScores(pickle.loads(sent.value))) if sent else None
        for batch in slices(batches):
            names, values = [], []
            texts = [item.as_py() for item in batch.column("__text")]
            for total in scores.totals(texts) if scores else np.zeros((len(texts), 1)):
                if total[-1]:
                    best = int(np.argmax(total[:-1]))
                    names.append(scores.model.languages[best])
                    values.append(min(1.0, float(total[best] / total[-1])))
                else:
                    names.append(UNKNOWN)
                    values.append(0.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(values, pa.float64())],
                [*keep, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Train on the labelled documents outside the held-out fold and predict every document."""
    model = train(docs, id_col, text, lang)
    return predict(docs, model, text, keep or (id_col,))
