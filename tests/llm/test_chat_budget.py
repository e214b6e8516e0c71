"""Windows keep their budget whatever the sizes of turns."""

from __future__ import annotations

import random

import pytest

from quillgrid.llm import chat


def made(seed):
    pick, rows, sizes = random.Random(seed), [], {}
    for conv in range(60):
        n = pick.randrange(1, 25)
        for turn in range(n):
            role = "system" if turn == 0 and pick.random() < 0.6 else ("user", "assistant")[turn % 2]
            words = pick.choice([0, 1, pick.randrange(30), pick.randrange(120), pick.randrange(300)])
            rows.append((conv, turn, role, " ".join(["w"] * words)))
            sizes[conv, turn] = words + chat.MARK_TOKENS
    return rows, sizes


@pytest.mark.parametrize("seed, budget, history", [(1, 512, 64), (2, 100, 20), (3, 64, 0), (4, 300, 100)])
def test_only_a_turn_that_is_longer_alone_exceeds_the_budget(spark, seed, budget, history):
    rows, sizes = made(seed)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(turns, budget, history)
    system = {c: sizes[c, 0] for c, t, role, _ in rows if t == 0 and role == "system"}
    held = {}
    for w in chat.read_windows(windows).collect():
        own = len(w.turns)
        held[w.conv_id] = held.get(w.conv_id, 0) + own
        longest = max(len(t.text.split()) + chat.MARK_TOKENS for t in w.turns)
        assert w.n_tokens <= budget or own == 1 and longest + system.get(w.conv_id, 0) + history > budget
    assert held == {c: sum(1 for r in rows if r[0] == c) for c in held} and len(held) == 60
    told = {r.conv_id: r.turns_text for r in chat.read_conversations(windows).collect()}
    assert told == {c: "".join(f"{role}\n{text}\n" for i, _, role, text in rows if i == c) for c in told}


def test_probe_of_long_system_turn(spark):
    sizes = [("system", 196), ("user", 52), ("assistant", 251), ("user", 252), ("assistant", 20), ("user", 20)]
    turns = spark.createDataFrame([(1, i, role, " ".join(["w"] * n)) for i, (role, n) in enumerate(sizes)], "conv_id long, turn long, role string, text string")
    assert max(r.n_tokens for r in chat.format_windows(turns).collect()) <= 200 + 256 + 64
