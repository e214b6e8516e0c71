"""Weak supervision: the posterior decides, it equals EM over the single documents, and it agrees with planted labels better than all rules must pass."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quillgrid.llm import quality

NAMES = [f"r{i}" for i in range(10)]


def brute_em(rows, rounds=600):
    """EM document by document; the posterior of each."""
    votes = np.array(rows)
    n, k = votes.shape
    bad, good = (votes == -1).sum(axis=1), (votes == 1).sum(axis=1)
    fixed = np.where(bad >= 3, 0.0, np.where((bad == 0) & (good >= 8), 1.0, np.nan))
    p = 1 / (1 + np.exp(-(math.log(9) * (0.5 - bad))))
    for _ in range(rounds):
        q = np.where(np.isnan(fixed), p, fixed)
        odds = np.full(n, math.log((q.sum() + 1) / ((1 - q).sum() + 1)))
        for j in range(k):
            for v in (-1, 0, 1):
                x = votes[:, j] == v
                odds[x] += math.log((q[x].sum() + {-1: 0.5, 0: 4, 1: 15.5}[v]) / (q.sum() + 20)) - math.log(((1 - q)[x].sum() + {-1: 8, 0: 4, 1: 8}[v]) / ((1 - q).sum() + 20))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p


def drawn(seed, n=3000):
    """Votes of ten rules, of which r9 is close to chance, and the class of each document."""
    random = np.random.default_rng(seed)
    good = random.random(n) < 0.8
    rows = []
    for g in good:
        row = [int(random.choice([1, 0, -1], p=[0.85, 0.13, 0.02] if g else [0.3, 0.2, 0.5])) for _ in range(9)]
        rows.append((*row, int(random.choice([1, 0, -1], p=[0.6, 0.1, 0.3] if g else [0.55, 0.1, 0.35]))))
    return rows, good


def counted(rows):
    found = {}
    for row in rows:
        found[row] = found.get(row, 0) + 1
    return sorted(found.items())


def posterior(prior, weights, votes):
    return 1 / (1 + math.exp(-(prior + sum(weights[n][v] for n, v in zip(NAMES, votes)))))


def test_patterns_equal_single_documents():
    rows, _ = drawn(1)
    prior, weights = quality.fit_votes(counted(rows), NAMES)
    assert np.allclose([posterior(prior, weights, r) for r in rows], brute_em(rows), atol=1e-6)


def test_weak_votes_do_not_drop_and_good_votes_do_not_save():
    rows, good = drawn(2)
    prior, weights = quality.fit_votes(counted(rows), NAMES)
    p = np.array([posterior(prior, weights, r) for r in rows])
    bad_votes = np.array([r.count(-1) for r in rows])
    kept = p >= 0.5
    assert (kept & (bad_votes > 0)).sum() > 100 and kept[[r[9] == -1 and r.count(-1) == 1 for r in rows]].all()
    assert any(not k and r.count(1) >= 5 for k, r in zip(kept, rows))
    assert (kept == good).mean() > 0.97 > (good == (bad_votes == 0)).mean() + 0.2
    assert abs(1 / (1 + math.exp(-prior)) - 0.8) < 0.03


def test_documents(spark, sf_dir):
    """On given documents the posterior decides and agrees with the labels at least as well as all rules must pass."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = quality.judge(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality"), "doc_id", "left").toPandas()
    votes = [tuple(r) for r in judged[list(quality.rules())].to_numpy()]
    assert np.allclose(judged.p_good, brute_em(votes), atol=1e-6)
    assert (judged.kept == (~judged.base_failed & (judged.p_good >= 0.5))).all() and (judged.p_good >= 0.5).mean() > 0.7
    passed = ~judged.base_failed & np.array([-1 not in v for v in votes])
    known = judged.quality.notna()
    assert (judged.kept == (judged.quality == 1))[known].mean() >= (passed == (judged.quality == 1))[known].mean() - 0.01


@pytest.mark.parametrize("text, fate", [("clean", True), ("symbols", False)])
def test_planted(spark, text, fate):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    random = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in random.integers(0, 26, random.integers(3, 8))) for _ in range(200)]
    lines = [" ".join(words[i:i + 10]).capitalize() + "." for i in range(0, 200, 10)]
    if text == "symbols":
        lines = [line.replace(" ", "### ").replace(".", "$$$ %%%") for line in lines]
    planted = docs.union(spark.createDataFrame([(-1, "\n".join(lines))], "doc_id long, text string"))
    got = quality.judge(planted).where("doc_id = -1").first()
    assert got.kept is fate, {n: got[n] for n in quality.rules()}
