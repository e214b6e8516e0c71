"""Slow, plain versions of the operators for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def components(nodes, linked) -> dict:
    """Smallest node reachable, by union of all pairs for which linked(a, b)."""
    nodes = sorted(nodes)
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def simhash(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def contamination(text, items) -> tuple:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words, hit, found = re.findall(pattern, lower(text)), set(), set()
    for item_id, item in items:
        own = re.findall(pattern, lower(item))
        n = min(13, len(own))
        windows = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item_id))
    return len(words), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(words)


def quality_counts(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts, covered = Counter(grams), set()
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def personal_data(text: str | None) -> list[tuple]:
    def holds(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return {
            "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
            "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
        }[kind]()

    spans = [(m.start(), rank, m.end(), kind) for rank, kind in enumerate(PII) for m in re.finditer(PII[kind], text or "") if holds(kind, m.group())]
    return sorted(spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
