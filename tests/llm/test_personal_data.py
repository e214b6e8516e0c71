"""Contextual extraction: the added spans against a brute-force version, and precision and recall on planted identifiers."""

from __future__ import annotations

import random
import re

import brute
import pytest

from quillgrid.llm import personal_data as pd_

WORD = r"(?=[^\s0-9@=:\"'<>]*[0-9@])[^\s=:\"'<>]+"
CANDIDATE = re.compile(rf"(?<![^\s=:\"'<>]){WORD}(?: {WORD})*")
NAMED = re.compile(r"(?:^|[^a-z0-9_])(?:password|passwd|pwd|token|secret|api_key|apikey)\s*[=:]\s*[\"']?$")
RANK = ("email", "ip", "card", "phone", "secret")


def shape(value):
    if not re.search("[A-Za-z]", value) or len(value) > 64:
        return None
    for name, form in (("hex", "[0-9a-f]+"), ("capitals", "[0-9A-Z]+"), ("letters", "[0-9A-Za-z]+")):
        if re.fullmatch(form, value):
            return f"{name} {len(value)}"
    return re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", value)))


def spans_of(docs):
    """All spans of each document by the method, without Spark."""
    candidates, base = set(), {}
    for key, text in enumerate(docs):
        base[key] = brute.personal_data(text)
        found = list(CANDIDATE.finditer(text or ""))
        for n, m in enumerate(found):
            inside = [b for b in base[key] if b[0] <= m.end() - 1]
            before = text[(found[n - 1].end() if n else 0):m.start()]
            after = text[m.end():(found[n + 1].start() if n + 1 < len(found) else len(text))]
            begun = [b for b in inside if b[0] >= m.start()]
            if not begun and any(b[2] > m.start() for b in inside):
                continue
            words = re.sub(r"[\s=:\"'<>]+", " ", before[-80:].lower()).split(" ")
            words = [w for w in words if w]
            behind = [w for w in re.sub(r"[\s=:\"'<>]+", " ", after[:80].lower()).split(" ") if w]
            contexts = words[-1:] + ([" ".join(words[-2:])] if len(words) > 1 else []) + [f"behind: {w}" for w in behind[:1]]
            contexts += [f"shape: {shape(m.group())}"] * (shape(m.group()) is not None)
            secret = NAMED.search(before[-80:].lower()) and len(m.group()) >= 8 or re.fullmatch("AKIA[0-9A-Z]{16}", m.group())
            kind = max(begun)[3] if begun else "secret" if secret else None
            candidates.add((key, m.start(), m.end(), m.group(), kind, tuple(contexts)))
    seeds = {(v, k): 1.0 for _, _, _, v, k, _ in candidates if k}
    pairs = {(c, v) for _, _, _, v, _, cs in candidates for c in cs}
    seeded = {v for v, _ in seeds}
    values, by_context, by_value = dict(seeds), {}, {}
    for c, v in pairs:
        by_context.setdefault(c, []).append(v)
        by_value.setdefault(v, []).append(c)
    for _ in range(3):
        scores = {}
        for c, vs in by_context.items():
            for k in RANK:
                if any((v, k) in values for v in vs):
                    scores[c, k] = sum(values.get((v, k), 0) for v in vs) / (len(vs) + 2)
        values = dict(seeds)
        for v, cs in by_value.items():
            for k in RANK:
                good = [scores[c, k] for c in cs if scores.get((c, k), 0) >= 0.7]
                if good and v not in seeded:
                    values[v, k] = max(good)
    out = {key: list(spans) for key, spans in base.items()}
    for key, start, end, _, kind, contexts in candidates:
        sure = [(scores[c, k], -RANK.index(k), k) for c in contexts for k in RANK if kind is None and scores.get((c, k), 0) >= 0.8]
        if kind == "secret" or sure:
            k = "secret" if kind else max(sure)[2]
            out[key].append((start, RANK.index(k), end, k))
    return {key: sorted(spans) for key, spans in out.items()}


def planted():
    pick = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]
    fill = lambda n: " ".join(pick.choice(words) for _ in range(n))
    digits = lambda n: "".join(pick.choice("0123456789") for _ in range(n))
    code = lambda n: "".join(pick.choice("0123456789abcdef") for _ in range(n - 1)) + "7"
    docs, hidden = [], {}
    for i in range(60):
        docs.append(f"{fill(5)} phone +1 ({digits(3)}) 555-{digits(4)} {fill(4)}")
        docs.append(f"{fill(3)} token = \"{code(40)}\" {fill(3)} password={code(18)}")
        docs.append(f"{fill(4)} write to u{i}@mail.example.com now {fill(2)}")
        docs.append(f"{fill(4)} chapter {i} of {pick.randrange(90)} {fill(3)} version 2.{i}")
    for i in range(20):
        for kind, text, value in (
            ("phone", "phone {}", f"({digits(3)}) 555-{digits(4)}"), ("secret", fill(1) + " {}", code(40)), ("email", "write to {} now", f"u{i}(at)mail{i}.org")):
            before = f"{fill(3)} {text.split('{}')[0]}"
            hidden[len(docs)] = (len(before), kind, len(before) + len(value))
            docs.append(before + value + text.split("{}")[1] + f" {fill(3)}")
    return docs, hidden


def found_by_spark(spark, docs):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    return {r.doc_id: [tuple(s) for s in r.spans] for r in pd_.find_personal_data(frame).collect()}


def test_planted_identifiers(spark):
    docs, hidden = planted()
    got = found_by_spark(spark, docs)
    assert got == spans_of(docs)
    caught = sum((start, kind, end) in {(s, k, e) for s, _, e, k in got[i]} for i, (start, kind, end) in hidden.items())
    assert caught >= 0.9 * len(hidden)
    for i, text in enumerate(docs):
        if "chapter" in text:
            assert got[i] == []


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_given_documents(spark, size):
    rows = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    docs = [r.text for r in rows]
    got = found_by_spark(spark, docs)
    assert got == spans_of(docs)
    if size == "sf0.01":
        secrets = sum(s[3] == "secret" for spans in got.values() for s in spans)
        assert secrets >= sum(len(re.findall(r"AKIA[0-9A-Z]{16}|password=\w+|token = \"\w+\"", t or "")) for t in docs) > 0
