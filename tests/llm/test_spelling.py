"""Spelling variants: signatures, near pairs and roots against brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter
import re

import pytest

from quillgrid.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if i is not None and (h := zlib.crc32(f"{i}:{run}".encode())) % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    form, sizes = {}, {}
    for w, n in words.items():
        found = sorted((-words[x], x) for x in words if near(w, x))
        sizes[w] = len(found)
        form[w] = found[0][1] if found and -found[0][0] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, sizes[w], words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def made(seed, n):
    pick = random.Random(seed)
    base = ["".join(pick.choice("abcdeéüÿ") for _ in range(pick.randint(5, 9))) for _ in range(n)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(40):
            w = pick.choice(base)
            if pick.random() < 0.5:
                at = pick.randrange(len(w))
                w = pick.choice([w[:at] + w[at + 1:], w[:at] + pick.choice("abé") + w[at:], w[:at] + pick.choice("abé") + w[at + 1:], w.upper()])
            words.append(w)
        docs.append((i, " ".join(words) + "." + "-".join(words[:5])))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = made(seed, 12) + [(None, "ééééé " * 4), (1000, None), (1001, ""), (1002, "1234 ab"), (7, "abcde " * 5000), (7, "abcde " * 5000), (8, "x" * 70000 + " " + "y" * 5)]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, n string")
    got = sorted(map(tuple, spelling.variants(frame).collect()), key=str)
    assert got == brute(docs)


def test_every_near_pair_shares_a_key():
    pick = random.Random(4)
    for _ in range(300):
        a = "".join(pick.choice("abcdefghé") for _ in range(pick.randint(5, 12)))
        at = pick.randrange(len(a))
        for b in (a[:at] + "z" + a[at + 1:], a[:at] + a[at + 1:]):
            parts = spelling.SAME if len(a) == len(b) else spelling.APART
            x, y = spelling.signatures([a, b], *parts)
            assert set(x) & set(y)


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_chain_of_forms(spark):
    words = [("a" * (5 + i), 3 * 2**i) for i in range(20)]
    got = {r.word: r.root for r in spelling.group_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert set(got.values()) == {"a" * 24} and len(got) == 20
