"""A perceptron with rectified layers, trained by mini-batches over stored blocks.

Rows lie in blocks of ``BLOCK_ENTRIES`` stored values. A step takes the next rows
of every block; tasks work out the gradients and add them up, sums meet by ranges of
terms, as many as the first layer's size asks for, and the driver makes one Adam step.
Only terms that occur in the step have a gradient in the first layer, so what
moves is bounded by the step, and the driver's state by the size of the network.
An epoch has ``STEPS`` steps at every size, so the rows of a step grow with the table
and the number of passes does not. Blocks are kept by the executors while they last.

A tenth of the rows, chosen by a hash of their values, is held out. Its accuracy
after each epoch decides: fitting ends after ``PATIENCE`` epochs without a gain of
``TOLERANCE``, and the best epoch's weights stay.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from quillgrid import settings
from quillgrid.operators.blocks import Rows, rows_of, store_rows, width_of
from quillgrid.operators.worker_state import received, send

LABEL, FEATURES = "label_enc", "features"
BLOCK_ENTRIES = 150_000
STEPS = 8
# Numbers of the first layer that one task adds up.
SLOT_VALUES = 250_000
RATE = 2e-3
DECAY_ONE, DECAY_TWO, SMALL = 0.9, 0.999, 1e-8
PENALTY = 1e-4
HELD_OUT = 10
PATIENCE = 10
TOLERANCE = 1e-4

Layers = list[tuple[np.ndarray, np.ndarray]]


def fresh(sizes: Sequence[int], seed: int) -> Layers:
    """Uniform weights with the spread of the layer's two widths."""
    random = np.random.default_rng(seed)
    layers = []
    for a, b in zip(sizes, sizes[1:]):
        bound = np.sqrt(6.0 / (a + b))
        layers.append((random.uniform(-bound, bound, (a, b)).astype(np.float32), random.uniform(-bound, bound, b).astype(np.float32)))
    return layers


def activations(layers: Layers, rows: Rows) -> list[np.ndarray]:
    """The output of every layer; the last is the probability of each class."""
    out, dense = [], rows.filled(len(layers[0][0]), layers[0][0].dtype)
    for k, (weights, shift) in enumerate(layers):
        z = ((rows.times(weights) if dense is None else dense @ weights) if k == 0 else out[-1] @ weights) + shift
        if k + 1 < len(layers):
            out.append(np.maximum(z, 0.0))
        else:
            grown = np.exp(z - z.max(axis=1, keepdims=True, initial=-np.inf))
            out.append(grown / grown.sum(axis=1, keepdims=True))
    return out


def gradients(layers: Layers, rows: Rows) -> tuple[float, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sum of the losses over the rows, the terms that occur, the gradient of their first weights, and the other gradients in order."""
    out = activations(layers, rows)
    each = np.arange(len(rows))
    loss = float(-np.log(np.maximum(out[-1][each, rows.labels], 1e-12)).sum())
    delta = out[-1].copy()
    delta[each, rows.labels] -= 1.0
    others: list[np.ndarray] = []
    for k in range(len(layers) - 1, 0, -1):
        others = [out[k - 1].T @ delta, delta.sum(axis=0), *others]
        delta = (delta @ layers[k][0].T) * (out[k - 1] > 0)
    dense = rows.filled(len(layers[0][0]), delta.dtype)
    terms, first = rows.transposed_times(delta) if dense is None else (np.arange(dense.shape[1]), dense.T @ delta)
    return loss, terms, first, [delta.sum(axis=0), *others]


class _Adam:
    def __init__(self, values: list[np.ndarray], rate: float):
        self.values, self.rate, self.count = values, rate, 0
        self.one, self.two = ([np.zeros_like(v) for v in values] for _ in range(2))

    def step(self, slopes: list[np.ndarray]) -> None:
        self.count += 1
        rate = self.rate * np.sqrt(1 - DECAY_TWO**self.count) / (1 - DECAY_ONE**self.count)
        for value, one, two, slope in zip(self.values, self.one, self.two, slopes):
            one *= DECAY_ONE
            one += (1 - DECAY_ONE) * slope
            two *= DECAY_TWO
            two += (1 - DECAY_TWO) * slope * slope
            value -= rate * one / (np.sqrt(two) + SMALL)


@dataclass
class Perceptron:
    """Layers of the best epoch, the mean loss of each epoch, and the accuracy on the held-out rows after it."""

    layers: Layers
    losses: list[float] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    stopped: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        sent = send(df.sparkSession.sparkContext, self.layers)

        def scored(vectors: pa.Array) -> pa.Array:
            layers = received(sent)
            p = activations(layers, Rows.of(vectors, limit=len(layers[0][0])))[-1].astype(float)
            p /= p.sum(axis=1, keepdims=True)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.reshape(-1)))

        named = df.withColumn("_shares", F.arrow_udf(scored, "array<double>")(F.unwrap_udt(FEATURES)))
        best = (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double")
        return named.select(*df.columns, best.alias("prediction"), array_to_vector("_shares").alias("probability"))


def _step_rows(rows: Rows, epoch: int, step: int) -> Rows:
    """The rows of a block that are trained on in one step: an epoch takes each once, in an order of its own."""
    own = np.flatnonzero(rows.groups > 0)
    order = np.random.default_rng((epoch, len(rows))).permutation(own)
    return rows.take(order[step * len(own) // STEPS:(step + 1) * len(own) // STEPS])


def _pass(blocks: DataFrame, layers: Layers, epoch: int, step: int, judge: bool, slots: int, borders: np.ndarray) -> dict[int, tuple]:
    """Summed gradients by slot: ranges of terms, then the other layers with loss and counts (the last slot)."""
    sent = send(blocks.sparkSession.sparkContext, layers)

    def join(found: dict[int, tuple], slot: int, a, b) -> None:
        if slot not in found:
            found[slot] = a, b
        elif slot == slots:
            found[slot] = found[slot][0] + a, [x + y for x, y in zip(found[slot][1], b)]
        else:
            terms, back = np.unique(np.concatenate([found[slot][0], a]), return_inverse=True)
            total = np.zeros((len(terms), b.shape[1]), b.dtype)
            n = len(found[slot][0])
            total[back[:n]] += found[slot][1]
            total[back[n:]] += b
            found[slot] = terms, total

    def rows_out(found: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        for slot, parts in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([pickle.dumps(parts, 5)], pa.binary())], ["slot", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = received(sent)
        found: dict[int, tuple] = {}
        for batch in batches:
            for data in batch.column("data"):
                rows = rows_of(data)
                held = rows.take(np.flatnonzero(rows.groups == 0)) if judge else None
                right = int((activations(current, held)[-1].argmax(axis=1) == held.labels).sum()) if judge and len(held) else 0
                chosen = _step_rows(rows, epoch, step) if step >= 0 else rows.take(np.zeros(0, np.int64))
                loss, terms, first, others = gradients(current, chosen)
                cuts = np.searchsorted(terms, borders)
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if b > a:
                        join(found, k, terms[a:b], first[a:b])
                join(found, slots, np.array([loss, len(chosen), right, len(held) if judge else 0]), others)
        yield from rows_out(found)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for batch in batches:
            for slot, data in zip(batch.column("slot").to_pylist(), batch.column("data")):
                join(found, slot, *pickle.loads(data.as_py()))
        yield from rows_out(found)

    kind = "slot int, data binary"
    met = blocks.select("data").mapInArrow(run, kind).withColumn("to", F.pmod("slot", F.lit(slots))).repartitionById(slots, F.col("to"))
    found = {r.slot: pickle.loads(r.data) for r in met.select("slot", "data").mapInArrow(add, kind).collect()}
    sent.unpersist()
    return found


def fit_perceptron(
    train: DataFrame, hidden: Sequence[int] = settings.MLP_HIDDEN, max_epochs: int = settings.MLP_MAX_ITER, seed: int = settings.SEED,
    rate: float = RATE, patience: int = PATIENCE,
) -> Perceptron:
    """Adam over mini-batches until the held-out accuracy stops growing; without held-out rows, for all epochs."""
    spark = train.sparkSession
    vector = F.unwrap_udt(FEATURES)
    role = F.when(F.pmod(F.xxhash64(F.lit(seed), vector["indices"], vector["values"]), F.lit(HELD_OUT)) == 0, 0).otherwise(1)
    blocks = store_rows(train, LABEL, FEATURES, role, BLOCK_ENTRIES, "perceptron-rows").persist(StorageLevel.MEMORY_AND_DISK)
    width, classes = width_of(train, FEATURES), int(train.agg(F.max(LABEL)).first()[0]) + 1
    layers = fresh([width, *hidden, classes], seed)
    slots = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), layers[0][0].size // SLOT_VALUES))
    values = [x for pair in layers for x in pair]
    adam, best, model = _Adam(values, rate), None, Perceptron(layers)
    borders = np.linspace(0, width, slots + 1).astype(int)

    def judged(found: dict[int, tuple]) -> bool:
        """Take down the held-out accuracy; whether to go on."""
        nonlocal best
        _, _, right, held = found[slots][0]
        if not held:
            return True
        model.scores.append(right / held)
        if best is None or model.scores[-1] > best[0] + TOLERANCE:
            best = model.scores[-1], len(model.scores), [v.copy() for v in values]
        model.stopped = len(model.scores) - best[1] >= patience
        return not model.stopped

    for epoch in range(max_epochs):
        if epoch and not judged(_pass(blocks, layers, epoch, -1, True, slots, borders)):
            break
        total = np.zeros(2)
        for step in range(STEPS):
            found = _pass(blocks, layers, epoch, step, False, slots, borders)
            counts, others = found[slots]
            if not counts[1]:
                continue
            total += counts[:2]
            first = layers[0][0] * PENALTY
            for slot, (terms, slope) in found.items():
                if slot != slots:
                    first[terms] += slope
            slopes = [first, *others]
            for k, value in enumerate(values):
                if k and value.ndim == 2:
                    slopes[k] = slopes[k] + PENALTY * value
            adam.step([(s / counts[1]).astype(np.float32) for s in slopes])
        model.losses.append(float(total[0] / max(1.0, total[1])))
    else:
        judged(_pass(blocks, layers, max_epochs, -1, True, slots, borders))
    blocks.unpersist()
    kept = best[2] if best else values
    model.layers = [(kept[2 * k].copy(), kept[2 * k + 1].copy()) for k in range(len(layers))]
    return model
