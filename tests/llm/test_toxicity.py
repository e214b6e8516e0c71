"""Toxicity: transducers, composition, learnt pieces and held-out results."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import toxicity


@pytest.fixture(scope="module")
def grammar():
    return toxicity.Grammar({"idiot": (100, 0), "lowe*": (50, 1)}, 200, 2000)


def kinds(grammar, text):
    found = grammar.features(text)
    return {k for k, x in zip(toxicity.KINDS, found[1:]) if x}


@pytest.mark.parametrize("text, want", [
    ("what an idiot, really", {"plain"}), ("You are an idiot", {"aimed"}), ("idiot, yes you", {"plain", "aimed"}),
    ("not an idiot at all", {"negated"}), ("She said. An idiot", {"plain"}), ("they claimed that an idiot came", {"reported"}),
    ('the word "idiot" is old', {"reported"}), ("I will kill you", {"threat"}), ("kill the lights", set()), ("never kill you", {"negated"}),
    ("loweient und du", {"plain", "aimed"}), ("idiotic idea", set()), ("", set()), (None, set()),
])
def test_kinds_of_matches(grammar, text, want):
    assert kinds(grammar, text) == want


def test_composition_equals_one_machine_after_the_other():
    machines = toxicity.negations(), toxicity.reports(), toxicity.aims()
    following, written = toxicity.compose(*machines)
    for seed in range(20):
        symbols = np.random.default_rng(seed).integers(0, 8, 200)
        want = list(map(int, symbols))
        for state, step in machines:
            for i, symbol in enumerate(want):
                state, want[i] = step(state, symbol)
        at, got = 0, []
        for symbol in symbols:
            got.append(int(written[at, symbol]))
            at = following[at, symbol]
        assert got == want


def test_own_count_is_taken_out():
    grammar = toxicity.Grammar({"rare": (1, 0)}, 50, 500)
    assert grammar.features("a rare word", 1)[1:].sum() == 0


def test_weights_against_gradient():
    random = np.random.default_rng(1)
    x = np.hstack([np.ones((300, 1)), random.random((300, 10))])
    y = (random.random(300) < 0.3).astype(float)
    w = toxicity.fit_weights(x, y)
    gradient = x.T @ (y - 1 / (1 + np.exp(-x @ w))) - (w - toxicity.PRIOR) / toxicity.PRIOR_DEVIATION**2
    assert np.abs(gradient).max() < 1e-6


@pytest.fixture(scope="module")
def planted(spark):
    """Clean documents, and toxic ones with one of a few made insults; words of one label only by insult."""
    pick = np.random.default_rng(2)
    rows = []
    for i in range(1500):
        words = [f"w{chr(97 + a)}{chr(97 + b)}rd" for a, b in pick.integers(0, 26, (40, 2))]
        toxic = i % 7 == 0
        if toxic:
            words[int(pick.integers(40))] = ["grumblefink", "schnorf" + "xyzuv"[int(pick.integers(5))] * 2][i % 2]
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return docs, labels


def test_held_out(planted):
    docs, labels = planted
    scored = toxicity.score_documents(docs, labels).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    right = scored.where((F.col("score") >= 0.5) == (F.col("toxic") == 1)).count()
    assert right >= 0.98 * scored.count()


def test_held_out_labels_are_not_read(planted, spark):
    docs, labels = planted
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("toxic", F.when(held_out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score_documents(docs, x).select("doc_id", F.round("score", 9)).collect() for x in (labels, other))
    assert sorted(a) == sorted(b)


def test_odd_rows(spark):
    rows = [(1, None, "c"), (2, "", "c"), (None, "some words", "c"), (4, "idiot " * 30000, "c"), (4, "idiot " * 30000, "c"), (5, "123", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (4, 1), (4, 0), (99, 0)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 5, None)}) == 1
    assert len(toxicity.score_documents(docs, labels.limit(0)).collect()) == 6
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
