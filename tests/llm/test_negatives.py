"""Hard negatives: exact scores from residues, windows and ties against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import negatives


@pytest.mark.parametrize("width, size", [(1, 5), (64, 200), (64, 1e9), (300, 1e17), (7, 1e38)])
def test_scores_are_exact(width, size):
    random = np.random.default_rng(width)
    a, b = (np.floor(random.uniform(-size, size, (n, width))) for n in (6, 9))
    got = negatives.residue_scores(a, b)
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert [[int(x) for x in r] for r in got] == want


def test_primes_stay_exact():
    for width in (1, 64, 1000):
        primes = negatives.primes_for(width, 10**18)
        assert math.prod(primes) > 2 * 10**18 and all(width * (p - 1) ** 2 < negatives.EXACT for p in primes)
        assert all(math.gcd(p, q) == 1 for i, p in enumerate(primes) for q in primes[:i])


def test_first_of_breaks_ties_by_id():
    scores = np.array([[3, 3, 3, 1, 9], [0, 0, 0, 0, 0]])
    row, column = negatives.first_of(scores, np.array([5, 4, 3, 2, 1]), np.array([[True, True, True, True, False]] * 2), 2)
    assert list(zip(row, column)) == [(0, 2), (0, 1), (1, 3), (1, 2)]
    row, column = negatives.first_of(scores.astype(object), np.array([5, 4, 3, 2, 1]), np.array([[True, True, True, True, False]] * 2), 2)
    assert list(zip(row, column)) == [(0, 2), (0, 1), (1, 3), (1, 2)]


def brute(rows, k=5):
    whole = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
             if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in whole:
        if i is None or i % 100:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))
        ranked = sorted(((-score(w), j, m) for j, m, w in whole if j is not None and j != i))
        for ps, p, _ in [x for x in ranked if x[2] == lab][:k]:
            found = [x for x in ranked if x[2] != lab and -80 * ps <= -100 * x[0] <= -100 * ps]
            out += [(i, p, n + 1, x[1], -ps, -x[0]) for n, x in enumerate(found[:k])]
    return sorted(out)


def test_odd_rows_against_brute_force(spark):
    random = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in random.normal(0, 0.1, 8)], int(i) % 3) for i in range(0, 900, 3)]
    same = [0.3] * 8
    rows += [(i, same, i % 2) for i in range(1, 400, 3)]  # one vector many times
    rows += [(100000, None, 1), (100100, [0.1] * 7 + [None], 1), (100200, [float("nan")] * 8, 1), (100300, [float("inf")] * 8, 1), (100400, same, None), (100500, [], 1)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, score string")
    got = negatives.mine(frame.repartition(7))
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert negatives.mine(frame.limit(0)).count() == 0


def test_great_scores_and_partition_count(spark):
    rows = [(i, [1e30 if i % 2 else 9.5e29, float(i)], i % 2) for i in range(0, 300, 50)] + [(7, [9.9e29, 1.0], 0), (9, [9.8e29, 1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r)[:4] for r in negatives.mine(frame).collect()]
    assert sorted(got) == sorted(r[:4] for r in brute(rows))
    assert sorted(got) == sorted(tuple(r)[:4] for r in negatives.mine(frame.repartition(5)).collect())


def test_groups_of_anchors(spark, monkeypatch):
    random = np.random.default_rng(5)
    frame = spark.createDataFrame([(int(i) * 10, [float(x) for x in random.normal(0, 0.2, 5)], int(i) % 4) for i in range(200)], "vec_id long, embedding array<double>, label int")
    whole = sorted(map(tuple, negatives.mine(frame).collect()))
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 4)
    monkeypatch.setattr(negatives, "BLOCK", 16)
    assert sorted(map(tuple, negatives.mine(frame).collect())) == whole
