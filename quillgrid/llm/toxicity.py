"""Toxicity by a weighted grammar of finite-state transducers over clauses.

Words become symbols: insult, threat, target, negation, report, quote mark, end of
clause, other. Small deterministic transducers read the symbols and mark insults
and threats that are negated, reported or aimed at somebody; composed, they are
one table that reads a document once. Each clause gets the weights of its matches
by kind, so a negated or quoted insult does not weigh like a plain one.

Function words and verbs of threat are fixed lists. Insults are learnt: words and
beginnings of words whose odds in toxic documents are surely higher, counted by
Spark over a bounded sample of labelled rows (``MAX_LABELLED``, by hash of the
id, near copies once); at most ``MAX_PIECES`` reach the driver. Weights of clause
kinds come from a logistic regression with a prior on the same rows, in which a
document's own count is taken out of the pieces it matches.

Defined cases: null and empty texts have no match and get the score of such a
document; labels that are null, or of unknown ids, teach nothing; an id with
several labels is toxic if one says so; without labels of both kinds the fixed
lists and the prior decide; repeated rows are scored alike; an empty table gives no
rows; other columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillgrid.llm.batches import keep_one, slices
from quillgrid.session import broadcast_if_small, materialize

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n\"«»“”„]")

# Words of four languages by their part in a clause.
TARGETS = (
    "you your yours u he she they them him her those these "
    "tu toi te vous ton ta tes il elle ils elles "
    "du dich dir dein deine ihr euch er sie "
    "tú usted ustedes vosotros él ella ellos ellas"
).split()
NEGATIONS = "not no never without isn aren don wasn ne pas jamais non sans nicht kein keine nie ohne nunca sin ni".split()
REPORTS = (
    "said says say claims claimed quoted wrote writes reported called "
    "dit disait écrit affirme sagt sagte schrieb behauptet dijo dice escribió afirmó"
).split()
THREATS = (
    "kill hurt destroy beat shoot burn punish die "
    "tuer frapper détruire brûler mourir töten umbringen schlagen vernichten sterben matar golpear destruir quemar morir"
).split()
MARKS = {**dict.fromkeys(".!?;:\n", "end"), **dict.fromkeys("\"«»“”„", "quote")}

MAX_LABELLED = 20_000
MAX_PIECES = 20_000
MIN_BEGINNING = 3
LONGEST = 24
SURE_ODDS = 4.0
DEVIATIONS = 2.0
THREAT_WEIGHT = 3.0
WINDOW = 4
WORDS_HELD = 400_000

KINDS = ("plain", "aimed", "threat", "negated", "reported")
# Prior of the regression: constant, then greatest clause weight and number of clauses (log) by kind.
PRIOR = np.array([-2.5, 1.0, 1.5, 1.0, 0.2, 0.2, 0.5, 0.5, 0.5, 0.1, 0.1])
PRIOR_DEVIATION = np.array([3.0] + [1.0] * 10)

# A symbol is a base and marks; transducers add marks and leave the rest as it is.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(8)
NEGATED, REPORTED, AIMED, THREATENED = 8, 16, 32, 64
BASE = 7
BASES = {"other": OTHER, "quote": QUOTE, "end": END}

Machine = tuple[object, Callable[[object, int], tuple[object, int]]]


def negations(window: int = WINDOW) -> Machine:
    """Marks matches up to ``window`` words after a negation in the clause."""

    def step(left: int, symbol: int) -> tuple[int, int]:
        base = symbol & BASE
        if base == END:
            return 0, symbol
        if base == NEGATION:
            return window, symbol
        marked = symbol | NEGATED if left and base in (INSULT, THREAT) else symbol
        return max(0, left - 1), marked

    return 0, step


def reports() -> Machine:
    """Marks matches in quotes, and after a verb of saying up to the end of the clause."""

    def step(state: tuple[bool, bool], symbol: int) -> tuple[tuple[bool, bool], int]:
        said, quoted = state
        base = symbol & BASE
        if base == END:
            return (False, quoted), symbol
        if base == QUOTE:
            return (said, not quoted), symbol
        if base == REPORT:
            return (True, quoted), symbol
        return state, symbol | REPORTED if (said or quoted) and base in (INSULT, THREAT) else symbol

    return (False, False), step


def aims(window: int = WINDOW) -> Machine:
    """Marks matches near a target before them, and a target that follows an unmarked match, with the marks of that match."""

    def step(state: tuple[int, int, int], symbol: int) -> tuple[tuple[int, int, int], int]:
        target, left, match = max(0, state[0] - 1), max(0, state[1] - 1), state[2]
        base = symbol & BASE
        if base == END:
            return (0, 0, 0), symbol
        if base == TARGET:
            aimed = symbol | AIMED | match & (NEGATED | REPORTED) | (THREATENED if match & BASE == THREAT else 0)
            return (window, 0, 0), aimed if left else symbol
        if base in (INSULT, THREAT):
            return ((target, 0, 0), symbol | AIMED) if target else ((target, window, symbol), symbol)
        return (target, left, match if left else 0), symbol

    return (0, 0, 0), step


def compose(*machines: Machine) -> tuple[np.ndarray, np.ndarray]:
    """One table of next states and one of outputs: each machine reads what the one before writes."""
    start = tuple(m[0] for m in machines)
    number, waiting = {start: 0}, [start]
    following, written = [], []
    while len(following) < len(waiting):
        states = waiting[len(following)]
        rows, outs = [], []
        for base in range(8):
            symbol, then = base, []
            for (_, step), state in zip(machines, states):
                state, symbol = step(state, symbol)
                then.append(state)
            if tuple(then) not in number:
                number[tuple(then)] = len(waiting)
                waiting.append(tuple(then))
            rows.append(number[tuple(then)])
            outs.append(symbol)
        following.append(rows)
        written.append(outs)
    return np.array(following), np.array(written)


def kind_of(symbol: int) -> str | None:
    """Which kind of match a symbol written by the grammar is; threats count where they are aimed."""
    base, threat = symbol & BASE, symbol & BASE == THREAT or symbol & THREATENED
    if base not in (INSULT, THREAT, TARGET) or (base == TARGET or threat) and not symbol & AIMED:
        return None
    if symbol & (NEGATED | REPORTED):
        # The insult before a target was counted where it stands.
        return None if base == TARGET and not threat else "negated" if symbol & NEGATED else "reported"
    return "threat" if threat else "aimed" if symbol & AIMED else "plain"


class Grammar:
    """Words to symbols and weights, and documents to features of their clauses."""

    def __init__(self, pieces: dict[str, tuple[int, int]], toxic: int, clean: int):
        """``pieces``: (toxic, clean) documents by word, or by beginning of a word with ``*`` behind it."""
        self.pieces, self.toxic, self.clean = pieces, toxic, clean
        following, written = compose(negations(), reports(), aims())
        self.following, self.written = following.tolist(), written.tolist()
        self.kinds = {s: KINDS.index(kind_of(s)) if kind_of(s) else None for s in {x for row in self.written for x in row}}
        self.fixed = {w: s for words, s in ((TARGETS, TARGET), (REPORTS, REPORT), (NEGATIONS, NEGATION), (THREATS, THREAT)) for w in words}
        self.fixed |= {mark: BASES[name] for mark, name in MARKS.items()}
        self.known: dict[str, tuple[int, tuple[int, int] | None]] = {}

    def symbol(self, word: str) -> tuple[int, tuple[int, int] | None]:
        """Symbol of a word and the counts of the piece it matches: itself or its longest known beginning."""
        counts = self.pieces.get(word)
        for n in range(min(len(word), LONGEST), MIN_BEGINNING - 1, -1):
            if counts:
                return INSULT, counts
            counts = self.pieces.get(word[:n] + "*")
        return (INSULT, counts) if counts else (self.fixed.get(word, OTHER), None)

    def weight(self, counts: tuple[int, int] | None, label: int | None) -> float:
        """Log odds ratio of a piece, without the document itself if its label is given; never under zero."""
        if counts is None:
            return THREAT_WEIGHT
        t, c, a, b = *counts, self.toxic, self.clean
        if label is not None:
            t, a, c, b = (t - 1, a - 1, c, b) if label else (t, a, c - 1, b - 1)
        return max(0.0, _log_odds(max(0, t), max(0, c), a, b)) if sure(max(0, t), max(0, c), a, b) else 0.0

    def features(self, text: str | None, label: int | None = None) -> np.ndarray:
        out = np.zeros(1 + 2 * len(KINDS))
        out[0] = 1.0
        tokens = TOKEN.findall((text or "").lower())
        known = self.known
        if len(known) > WORDS_HELD:
            known.clear()
        words = set(tokens)
        for word in words:
            if word not in known:
                known[word] = self.symbol(word)
        if not any(known[word][0] in (INSULT, THREAT) for word in words):
            return out
        greatest, matched, clause, state, last = [0.0] * len(KINDS), [0] * len(KINDS), [0.0] * len(KINDS), 0, 0.0

        def close() -> None:
            for k, total in enumerate(clause):
                if total:
                    greatest[k], matched[k], clause[k] = max(greatest[k], total), matched[k] + 1, 0.0

        for word in tokens:
            symbol, counts = known[word]
            symbol, state = self.written[state][symbol], self.following[state][symbol]
            base = symbol & BASE
            if base == END:
                close()
                continue
            kind = self.kinds[symbol]
            if base in (INSULT, THREAT):
                last = self.weight(counts, label)
            if kind is not None:
                clause[kind] += last
        close()
        out[1:1 + len(KINDS)] = np.minimum(greatest, 20.0) / 5.0
        out[1 + len(KINDS):] = np.log1p(matched)
        return out


def _log_odds(t: float, c: float, toxic: float, clean: float) -> float:
    return float(np.log((t + 0.5) / (toxic + 1.0)) - np.log((c + 0.5) / (clean + 1.0)))


def sure(t: float, c: float, toxic: float, clean: float) -> bool:
    """Whether the odds ratio is above SURE_ODDS by DEVIATIONS standard deviations."""
    return _log_odds(t, c, toxic, clean) - DEVIATIONS * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) > np.log(SURE_ODDS)


def fit_weights(features: np.ndarray, labels: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression with a normal prior, by Newton steps; without rows, the prior."""
    weights, precision = PRIOR.copy(), 1.0 / PRIOR_DEVIATION**2
    for _ in range(rounds if len(labels) else 0):
        p = 1.0 / (1.0 + np.exp(-np.clip(features @ weights, -30, 30)))
        gradient = features.T @ (labels - p) - precision * (weights - PRIOR)
        hessian = (features * (p * (1 - p))[:, None]).T @ features + np.diag(precision)
        step = np.linalg.solve(hessian, gradient)
        weights = weights + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return weights


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, max_labelled: int) -> DataFrame:
    """(toxic, text) of at most about ``max_labelled`` training rows, near copies once.

    Copies are rows of one label whose least hash of three words is the same.
    """
    known = labels.where(F.col(label).isNotNull() & (F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 != 0))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))
    share = min(1.0, max_labelled / max(1, known.count()))
    known = broadcast_if_small(known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int(share * (1 << 20))))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(known, "__id").select("toxic", "text")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = []
            for item in batch.column("text"):
                words = TOKEN.findall(item.as_py().lower())
                values.append(min((zlib.crc32(" ".join(words[i:i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())], ["toxic", "text", "sketch"])

    return rows.mapInArrow(sketches, "toxic int, text string, sketch long").groupBy("toxic", "sketch").agg(F.min("text").alias("text")).drop("sketch")


def insult_pieces(rows: DataFrame, toxic: int, clean: int, max_pieces: int = MAX_PIECES) -> dict[str, tuple[int, int]]:
    """Words, and beginnings of words (``*`` behind), that are surely commoner in toxic documents, with their counts.

    Of a chain of beginnings that stand for nearly the same documents the longest is taken.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for label, item in zip(batch.column("toxic").to_pylist(), batch.column("text")):
                found = sorted({w for w in TOKEN.findall(item.as_py().lower()) if len(w) > 1})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())], ["word", "toxic"])

    counted = rows.mapInArrow(words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    beginnings = F.transform(F.sequence(F.lit(MIN_BEGINNING), F.least(F.length("word"), F.lit(LONGEST))), lambda n: F.concat(F.left(F.col("word"), n), F.lit("*")))
    pieces = counted.select("t", "c", F.explode(F.concat(F.array("word"), F.when(F.length("word") >= MIN_BEGINNING, beginnings).otherwise(F.array()))).alias("piece"))
    t, c = F.col("t"), F.col("c")
    odds = F.log((t + 0.5) / (toxic + 1.0)) - F.log((c + 0.5) / (clean + 1.0))
    likely = pieces.groupBy("piece").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(
        (t > 0) & (odds - DEVIATIONS * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) > float(np.log(SURE_ODDS))))
    found = {r.piece: (int(r.t), int(r.c)) for r in likely.orderBy(F.desc(odds), "piece").limit(max_pieces).collect()}
    longer = Counter()
    for piece, (n, _) in found.items():
        stem = piece.removesuffix("*")
        if not piece.endswith("*"):
            longer[f"{stem}*"] = max(longer[f"{stem}*"], n)
        elif len(stem) > MIN_BEGINNING:
            longer[f"{stem[:-1]}*"] = max(longer[f"{stem[:-1]}*"], n)
    return {piece: counts for piece, counts in found.items() if longer[piece] < 0.9 * counts[0]}


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED,
) -> tuple[tuple[dict[str, tuple[int, int]], int, int], np.ndarray]:
    """What a Grammar is made of, and the weights of clause features."""
    rows = materialize(labelled_rows(docs, labels, id_col, text, label, max_labelled), "toxic-rows")
    counts = dict(rows.groupBy("toxic").count().collect())
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return ({}, 0, 0), PRIOR.copy()
    parts = insult_pieces(rows, toxic, clean), toxic, clean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(*parts)
        for batch in slices(batches):
            for label_, item in zip(batch.column("toxic").to_pylist(), batch.column("text")):
                yield pa.RecordBatch.from_pydict({"toxic": pa.array([label_], pa.int32()), "features": [grammar.features(item.as_py(), label_).tolist()]})

    fitted = rows.mapInArrow(run, "toxic int, features array<double>").groupBy("toxic", "features").count().collect()
    features = np.array([r.features for r in fitted])
    times = np.array([r["count"] for r in fitted])
    return parts, fit_weights(np.repeat(features, times, axis=0), np.repeat([r.toxic for r in fitted], times))


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``keep``, score and number of matched clauses by kind of every document; one pass, no shuffle of texts."""
    keep = keep or (id_col,)
    parts, weights = train(docs, labels, id_col, text, label)
    sent = docs.sparkSession.sparkContext.broadcast((parts, weights))
    kept = docs.select(*keep, F.col(text).alias("__text"))
    schema = kept.drop("__text").withColumns({"score": F.lit(0.0), "clauses": F.array(F.lit(0))}).schema
    key = zlib.crc32(repr(sorted(parts[0].items())).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, by_kind = sent.value
        grammar = keep_one(("toxicity", key), lambda: Grammar(*held))
        for batch in slices(batches):
            features = np.array([grammar.features(item.as_py()) for item in batch.column("__text")]).reshape(batch.num_rows, len(PRIOR))
            scores = 1.0 / (1.0 + np.exp(-np.clip(features @ by_kind, -30, 30)))
            clauses = np.rint(np.expm1(features[:, 1 + len(KINDS):])).astype(int).tolist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(scores), pa.array(clauses, pa.list_(pa.int32()))], [*keep, "score", "clauses"])

    return kept.mapInArrow(run, schema)
