"""Each operator against a slow version, a round trip or held-out accuracy, on small inputs."""

from __future__ import annotations

import base64
import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import (
    chat, contamination, language, line_dedup, personal_data, pieces, quality, simhash, url_filters, warc,
)
from quillgrid.llm.components import connected_components
from quillgrid.llm.queries import LLM_QUERIES
from quillgrid.session import materialize


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    edges += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)] + [(None, 5), (1, 0), (1, 0)]
    found = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    joined = {frozenset(e) for e in edges if None not in e}
    nodes = {n for a, b in edges if a is not None and a != b for n in (a, b)}
    assert found == brute.components(nodes, lambda a, b: frozenset((a, b)) in joined)
    assert rows(connected_components(spark.createDataFrame([], "a string, b string"))) == []


def test_op1_matches_pages(spark, sf_dir):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    keeper = {}
    for page_id, payload in pages.items():
        keeper[payload] = max(page_id, keeper.get(payload, page_id))
    got = {r.page_id: r for r in LLM_QUERIES["op1_warc"](spark, sf_dir).collect()}
    assert set(got) == set(pages)
    for page_id, payload in pages.items():
        first = keeper[payload] == page_id
        assert (got[page_id].payload_bytes, got[page_id].payload_digest, got[page_id].record_type, got[page_id].refers_to) == (
            len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            "response" if first else "revisit", None if first else keeper[payload])


def test_archive_gives_back_payloads_in_chunks(spark):
    texts = [(1, "http://a/\r\n%0A", "é" * 3000), (2, None, "é" * 3000), (3, "x", None), (4, "y", ""), (5, "z", "WARC/1.1\r\n\r\n" * 50), (5, "z", "b")]
    pages = spark.createDataFrame(texts, "page_id long, url string, html string")
    spans = warc.write_archives(warc.payload_chunks(warc.plan_records(pages), 100), warc.scratch_path(spark, "warc"))
    chunks = warc.read_archives(spans, chunk_bytes=128).collect()
    assert all(c.is_last or len(c.data) == 128 for c in chunks if c.record_type == "response")
    assert all(c.payload_digest == c.declared_digest for c in chunks if c.is_last)
    full = sorted((c for c in chunks if c.record_id == 2), key=lambda c: c.chunk_no)
    assert b"".join(c.data for c in full).decode() == texts[1][2] and [c.offset for c in full] == list(range(0, 6000, 128))
    kinds = sorted((c.record_id, c.record_type, c.refers_to, c.payload_bytes, c.url) for c in chunks if c.is_last)
    assert kinds[:4] == [
        (1, "revisit", 2, 6000, texts[0][1]), (2, "response", None, 6000, None), (3, "revisit", 4, 0, "x"), (4, "response", None, 0, "y")]
    apart = warc.archive_round_trip(spark, pages, min_bytes=1)
    assert {r.record_type for r in apart.where("record_id in (3, 4)").collect()} == {"response"}


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "com/de/")]


def test_blocks_reach_aliases_but_not_allowed_classes(spark):
    pages = spark.createDataFrame([
        (1, "http://a.com/x", '<LINK href="/y" rel="canonical">'), (2, "http://a.com/y", ""),
        (3, "http://b.net/q", '<meta http-equiv="refresh" content="0; url=http://c.com/de/1">'), (4, "http://c.com/de/1", None),
        (5, None, None), (6, "nope", ""), (7, "http://d.org/", "<link rel=canonical href=http://e.net/>"),
        (8, "http://e.net/", "<link rel='canonical' href='http://www.C.com/de/2#f'>"), (9, "HTTP://B.net/q#top", ""),
        (10, "http://x.example.org/es/1?u", ""), (11, "http://org", ""), (12, "http://borg/", ""),
    ], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(pages, RULES).collect()}
    assert got == {
        1: ("a.com", "/x", None, "allow"), 2: ("a.com", "/y", None, "allow"), 3: ("b.net", "/q", None, "block"),
        4: ("c.com", "/de/1", "com/de/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("d.org", "/", "org/", "allow"), 8: ("e.net", "/", None, "allow"), 9: ("b.net", "/q", None, "block"),
        10: ("x.example.org", "/es/1", "example.org/es/", "block"), 11: ("org", "", None, "allow"), 12: ("borg", "/", None, "allow")}
    logged = spark.createDataFrame([("http://a.com/y", "http://c.com/de/9")], "a string, b string")
    more = {r.page_id: r.verdict for r in url_filters.judge_urls(pages, RULES, more_edges=logged).collect()}
    assert (more[1], more[2]) == ("block", "block")


def near_lines(seed: int) -> list[str]:
    rng = random.Random(seed)

    def change(text: str) -> str:
        chars = list(text)
        for _ in range(rng.randrange(5)):
            at, kind = rng.randrange(len(chars)), rng.randrange(3)
            chars[at:at + (kind != 0)] = [] if kind == 1 else [rng.choice("abé漢😀")]
        return "".join(chars)

    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(14, 30))) for _ in range(12)]
    made = {change(rng.choice(base)) for _ in range(150)} | {f"event number {i:04d} done" for i in range(60)}
    return sorted(line for line in made if len(line) >= 6)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_band_distance(threshold):
    rng, lines = random.Random(threshold), near_lines(7)
    left, right = [rng.choice(lines) for _ in range(500)], [rng.choice(lines) for _ in range(500)]
    right[:200] = [x[:3] + x[4:] + "z" for x in left[:200]]
    want = [brute.levenshtein(a, b) for a, b in zip(left, right)]
    got = line_dedup.edit_distances(left, right, threshold)
    assert all(g == w if w <= threshold else g > threshold for g, w in zip(got, want))


def test_distances_of_long_lines_with_many_edits():
    """A threshold per pair; the work grows with the edits, not with the length times the edits."""
    rng = random.Random(5)
    left, right, limit = [], [], []
    for size, letters in ((300, "ab "), (1500, "etaoin shrdlu"), (4000, "abé漢😀 "), (900, "".join(map(chr, range(300, 900))))):
        for k in range(12):
            text = "".join(rng.choices(letters, k=size))
            chars = list(text)
            for _ in range(rng.randrange(0, size // 20)):
                at, kind = rng.randrange(len(chars)), rng.randrange(3)
                chars[at:at + (kind != 0)] = [] if kind == 1 else [rng.choice(letters)]
            left.append(text)
            right.append("".join(chars) if k else "".join(rng.choices(letters, k=size)))
            limit.append(rng.choice([size * 3 // 100, size // 25, 3]))
    want = [line_dedup._whole_distance(a, b) for a, b in zip(left, right)]
    got = line_dedup.edit_distances(left, right, np.array(limit))
    assert all(g == w if w <= most else g > most for g, w, most in zip(got, want, limit))
    assert sum(w <= most for w, most in zip(want, limit)) > 10 and max(g for g, most in zip(got, limit) if g <= most) > 50
    near, distance = line_dedup.near_distances(left, right)
    allowed = line_dedup.allowed(np.array([min(len(a), len(b)) for a, b in zip(left, right)]))
    assert [bool(x) for x in near] == [w <= most for w, most in zip(want, allowed)] and all(distance[near] == np.array(want)[near])


@pytest.mark.parametrize("pairs", [line_dedup.PAIRS, 30])
def test_edit_join_finds_every_pair(spark, pairs):
    lines = near_lines(3)
    df = materialize(spark.createDataFrame([(x,) for x in lines], "line string").withColumn("h", F.xxhash64("line")), "test-lines")
    text = {r.h: r.line for r in df.collect()}
    got = {frozenset((text[r.a], text[r.b])): r.distance for r in line_dedup.links(df, 2, pairs).collect()}
    want = {}
    for i, a in enumerate(lines):
        for b in lines[i + 1:]:
            if abs(len(a) - len(b)) <= 2 and (d := brute.levenshtein(a, b)) <= 2:
                want[frozenset((a, b))] = d
    assert got == want


def test_op3_classes(spark):
    long = "a line that is long enough to be compared with all the others"
    docs = [(1, f"short\n{long}\nshort"), (2, f"  {long.replace('long', 'lang')}\nonly here, and long enough to be compared too"), (3, long), (None, None), (0, "short\n\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.kept) for r in line_dedup.line_classes(df).collect()}
    assert got[1, 1] == (1, 1, 1, True) and got[2, 0] == (1, 1, 1, False) and got[3, 0] == (1, 1, 1, False)
    assert all(v == (*k, 0, True) for k, v in got.items() if k not in ((1, 1), (2, 0), (3, 0))) and len(got) == 9
    left = {r.doc_id: r.text for r in line_dedup.remove_repeated_lines(df).collect()}
    assert left == {1: docs[0][1], 2: docs[1][1].split("\n")[1], 3: "", None: None, 0: "short\n\n"}


@pytest.fixture(scope="module")
def coder():
    return pieces.PieceCoder(pieces._model_bytes(None))


def test_pieces_have_the_best_score(coder):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    score = {
        model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    }
    names = {i: model.id_to_piece(i) for i in range(model.get_piece_size())}
    value = {i: b for b, i in coder.byte_ids.items()}
    rng = random.Random(2)
    alphabet = ["the", "The", " ", "  ", "\n", "é", "ß", "▁", "漢", "😀", "x", "ing", "\t", "a", "12", "\0", "…"]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(25)))
        ids = coder.encode(text).tolist()
        assert coder.decode(ids) == text
        # A character in bytes costs once, at its first byte.
        got = sum(coder.unknown * (value[i] & 0xC0 != 0x80) if i in value else score[names[i]] for i in ids)
        marked = (" " + text).replace("▁", "￾").replace(" ", "▁") if text else ""
        best = [0.0] + [-1e18] * len(marked)
        for end in range(1, len(marked) + 1):
            for start in range(max(0, end - 17), end):
                part = marked[start:end]
                if part in score:
                    best[end] = max(best[end], best[start] + score[part])
                elif end - start == 1:
                    best[end] = max(best[end], best[start] + coder.unknown)
        assert abs(got - best[-1]) < 1e-6


def test_long_texts_are_cut_between_words(coder, monkeypatch):
    text = "the quick  brown\nfox " * 300
    whole = coder.encode(text).tolist()
    monkeypatch.setattr(pieces, "SLICE_CHARS", 50)
    assert coder.encode(text).tolist() == whole and coder.decode(whole) == text
    for text in ("thequickbrownfox" * 30, " " * 200 + "thequick" * 20 + "  fox " * 40, "a\nb" * 100):
        monkeypatch.setattr(pieces, "SLICE_CHARS", 1 << 20)
        whole = coder.encode(text).tolist()
        monkeypatch.setattr(pieces, "SLICE_CHARS", 33)
        assert coder.encode(text).tolist() == whole and coder.decode(whole) == text


def test_worker_keeps_one_thing_across_copies_of_the_module():
    import importlib.util

    def copy():
        spec = importlib.util.spec_from_file_location("batches_copy", pieces.keep_one.__code__.co_filename)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        return module

    made = []
    for _ in range(3):
        copy().keep_one("a thing", lambda: made.append(1) or "thing")
    assert len(made) == 1
    copy().keep_one("another", lambda: "other")
    copy().keep_one("a thing", lambda: made.append(1))
    assert len(made) == 2
    copy().keep_none()


def test_op4_round_trip(spark, sf_dir, documents):
    got = LLM_QUERIES["op4_sentencepiece"](spark, sf_dir).collect()
    assert len(got) == len(documents) and all(r.round_trip for r in got)
    assert all(r.decoded_sha256 == brute.sha256(documents[r.doc_id].text or "") for r in got)


def test_decode_column(spark):
    docs = spark.createDataFrame([(1, "Hello  wörld\n"), (2, None), (3, "")], "doc_id long, text string")
    coded = pieces.encode(docs)
    assert sorted(rows(pieces.decode(coded))) == [(1, "Hello  wörld\n"), (2, ""), (3, "")]


@pytest.mark.parametrize("block", [contamination.BLOCK_CHARS, 100])
def test_op5_small(spark, block):
    rng = random.Random(3)

    def text(n):
        return " ".join(rng.choice(["a", "b", "Zz", "é", "q1", "ö"]) for _ in range(n))

    items = [(i, text(rng.choice([1, 3, 5, 7, 12, 13, 14, 20]))) for i in range(20)] + [(99, ""), (98, None)]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(500, None)] + [(501, items[19][1] + " " + text(20))] * 2
    found = contamination.decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=block)
    got = sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found.collect())
    assert got == sorted((i, *brute.contamination(t, items)) for i, t in docs)


def test_op5_query(spark, sf_dir, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for r in LLM_QUERIES["op5_benchmark_decontamination"](spark, sf_dir).collect():
        words, hit, found, bad = brute.contamination(documents[r.doc_id].text, items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (words, hit, len(found), brute.sha256(",".join(found)), bad)


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(200):
        span = rng.integers(0, 4, 13).astype(np.uint64)
        texts = [np.concatenate([rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64), span, rng.integers(0, 4, 9).astype(np.uint64)]) for _ in range(2)]
        prints = [set(g[contamination.winnow(g, 9)].tolist()) for g in (contamination.gram_hashes(t, 5) for t in texts)]
        assert prints[0] & prints[1]


def test_covering_masks_miss_no_pair():
    from itertools import combinations

    masks = simhash.covering_masks(list(range(64)))
    for bits in combinations(range(64), 3):
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_op6_query(spark, sf_dir, documents):
    got = {r.doc_id: r for r in LLM_QUERIES["op6_simhash_near_dedup"](spark, sf_dir).collect()}
    prints = {i: brute.simhash(r.text) for i, r in documents.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    want = brute.components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {i: r.component_id for i, r in got.items()} == want


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 32])
def test_hot_buckets_lose_no_link(spark, bucket):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {i: base[min(i % 37, 19)] ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (2 ** 64 - 1) for i in range(600)}
    prints = {i: p & (2 ** 64 - 1) for i, p in prints.items()}
    first = {}
    for i, p in prints.items():
        first.setdefault(p, i)
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for p, i in first.items()], "rep long, fingerprint long")
    found = dict(rows(connected_components(simhash.near_links(df, 3, bucket))))
    want = brute.components(first.values(), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {i: found.get(i, i) for i in first.values()} == want


def test_op7_query(spark, sf_dir):
    told = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        told.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    hard = r"\### Assistant: </turn> ok"
    told[-7] = [(0, "user", hard), (1, "assistant", hard)]
    got = {r.conv_id: r for r in LLM_QUERIES["op7_chat_formatting"](spark, sf_dir).collect()}
    assert set(got) == set(told)
    for conv_id, turns in told.items():
        turns.sort()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        every = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        assert tuple(got[conv_id])[1:5] == (len(turns), brute.sha256(every), len(loss), brute.sha256(loss))


def test_windows_keep_budget_system_and_history(spark):
    turns = [(1, 0, "system", "be brief")] + [(1, i, ("user", "assistant")[i % 2], " ".join(["w"] * (5 + i % 7))) for i in range(1, 60)]
    turns += [(1, 60, "user", " ".join(["long"] * 90)), (1, 61, None, r"\l<turn user>\b"), (2, None, "assistant", None), (None, 0, "user", "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a")]
    windows = chat.format_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 60, 20)
    own = sorted((r for r in chat.read_windows(windows).where("conv_id = 1").collect()), key=lambda r: r.window_start)
    assert len(own) > 10
    for i, window in enumerate(own):
        assert window.text.startswith("<turn system>be brief</turn>\n")
        assert (window.n_repeated > 0) == (i > 0)
        lengths = [len(t.text.split()) + 4 for t in window.turns]
        assert sum(lengths) <= 60 or len(lengths) == 1
    assert sum(len(w.turns) for w in own) == 62 and own[-1].turns[-1].text == r"\l<turn user>\b"
    back = {r.conv_id: (r.n_turns, r.turns_text, r.loss_text) for r in chat.read_conversations(windows).collect()}
    assert back[2] == (1, "assistant\n\n", "") and back[None] == (1, "user\nx\n", "") and back[3] == (2, "assistant\na\nassistant\nb\n", "ab")


def test_op8_query(spark, sf_dir, documents):
    for r in LLM_QUERIES["op8_pii"](spark, sf_dir).collect():
        spans = brute.personal_data(documents[r.doc_id].text)
        text = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)
        assert tuple(r)[1:6] == (*(sum(s[3] == kind for s in spans) for kind in brute.PII), brute.sha256(text))
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(4)
    parts = ["a", "@", ".", "1", "25", "6", "+", " ", "-", "(", ")", "é", "😀", "_", "4111 1111 1111 1111", "b.c", "x@y.z", "\n", "1.2.3.4", "+1 (386) 555-3733"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(600)] + ["1.2.3.4 " * 2000, "a" * 30000, "1" * 30000, "+" + "(" * 9999, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in personal_data.base_spans(df, "text").collect():
        assert [tuple(s) for s in r.base] == brute.personal_data(r.text)


def test_contexts_find_unseen_identifiers(spark):
    docs = [(i, f"hello e-mail: user{i}@mail.org bye") for i in range(30)] + [(100, "say e-mail: user(at)m1.org bye")] * 2
    docs += [(200 + i, f"version 3.{i} of it") for i in range(20)] + [(300, None)]
    found = personal_data.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string"))
    got = found.select("doc_id", personal_data.span_text("spans").alias("s")).collect()
    assert [r.s for r in got if r.doc_id == 100] == ["email:12:26"] * 2
    assert all(r.s == "" for r in got if r.doc_id >= 200) and all(r.s for r in got if r.doc_id < 30)


def test_op9_query(spark, sf_dir, documents):
    got = LLM_QUERIES["op9_quality_rules"](spark, sf_dir).collect()
    assert len(got) == len(documents)
    for r in got:
        counts = brute.quality_counts(documents[r.doc_id].text)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*counts, failed)
        assert not (failed and r.kept)
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [(r.kept, good[r.doc_id]) for r in got if r.doc_id in good and not r.base_failed]
    assert sum(kept == bool(q) for kept, q in judged) >= 0.95 * len(judged)


def test_votes_find_the_accurate_rules():
    rng, patterns = random.Random(0), {}
    for _ in range(4000):
        good = rng.random() < 0.7
        votes = tuple(0 if rng.random() < 0.3 else (1 if good else -1) * (1 if rng.random() < a else -1) for a in (0.95, 0.9, 0.6))
        patterns[votes] = patterns.get(votes, 0) + 1
    _, weights = quality.fit_votes(sorted(patterns.items()), ["a", "b", "c"])
    assert weights["a"][-1] < weights["c"][-1] <= 0 and weights["a"][1] > weights["c"][1] >= 0


def test_gradients_are_those_of_the_loss():
    model = language.ByteTagger.fresh(["a", "b", "c"], 4, np.random.default_rng(1))
    codes, target = np.array([[1, 2, 3, 2], [4, 2, 1, 1]], np.uint8), np.array([0, 2])
    _, gradients = model.gradients(codes, target)
    rng = np.random.default_rng(2)
    for values, gradient in zip(model.parameters(), gradients):
        for _ in range(8):
            at = tuple(int(rng.integers(n)) for n in values.shape)
            at = (at[0], int(rng.integers(1, 5)), at[2]) if values is model.table else at
            kept = values[at]
            values[at] = kept + 1e-2
            above = model.gradients(codes, target)[0]
            values[at] = kept - 1e-2
            below = model.gradients(codes, target)[0]
            values[at] = kept
            assert abs((above - below) / 2e-2 - gradient[at]) < 2e-3


def test_op10_held_out_accuracy(spark, sf_dir, documents):
    import zlib

    got = LLM_QUERIES["op10_language_id"](spark, sf_dir).collect()
    assert len(got) == len(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_language_does_not_depend_on_slices_or_table(monkeypatch):
    model = language.ByteTagger.fresh(["a", "b"], 4, np.random.default_rng(1))
    texts = ["one two three " * 50, None, "1234 !!", "", "x" * 100, "été"]
    whole = language.WordScores(model).totals(texts)
    monkeypatch.setattr(language, "SLICE_CHARS", 30)
    monkeypatch.setattr(language, "SCORED_TOGETHER", 1)
    parts = language.WordScores(model, held=2).totals(texts[:4] + ["", "été"])
    assert np.allclose(whole[[0, 1, 2, 3, 5]], parts[[0, 1, 2, 3, 5]]) and not whole[1:4].any()


@pytest.mark.parametrize("name", ["op1_warc", "op2_url_filters", "op5_benchmark_decontamination", "op7_chat_formatting"])
def test_matches_sql(name, spark, sf_dir):
    from harness import compare, duck

    from quillgrid.llm.queries import LLM_ORACLE

    assert compare(LLM_QUERIES[name](spark, sf_dir), duck(sf_dir), LLM_ORACLE[name]) is None


def test_aliases_match_sql(spark, tmp_path):
    """Links, redirects and rules that the tables do not hold."""
    from harness import _rows
    import duckdb

    from quillgrid.llm.queries import LLM_ORACLE

    pages = spark.createDataFrame([
        (1, "http://a.com/x", '<LINK href="/y" rel="canonical">'), (2, "http://a.com/y", ""), (4, "http://c.com/de/1", None),
        (3, "http://b.net/q", '<meta http-equiv="refresh" content="0; url=http://c.com/de/1">'), (5, None, None), (6, "nope", ""),
        (7, "http://d.org/", "<link rel=canonical href=http://e.net/>"), (8, "http://e.net/", "<link rel='canonical' href='http://www.C.com/de/2#f'>"),
        (9, "HTTP://B.net/q#top", ""), (10, "http://x.example.org/es/1?u", ""), (11, "http://b.net/z/", '<link rel="canonical" href="../q">'),
    ], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    cursor = connection.execute(LLM_ORACLE["op2_url_filters"])
    want = _rows([c[0] for c in cursor.description], cursor.fetchall())
    got = LLM_QUERIES["op2_url_filters"](spark, str(tmp_path))
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == want


@pytest.mark.parametrize("pairs", [line_dedup.PAIRS, 1])
def test_edits_grow_with_the_line(spark, pairs):
    rng, words = random.Random(8), ["".join(random.Random(i).choices("abcdeimnorst", k=2 + i % 8)) for i in range(300)]
    base = [" ".join(rng.choices(words, k=k)) for k in (4, 6, 10, 15, 19, 25, 40, 70, 250) for _ in range(4)]
    made = set(base) | {"read the notice of the publisher before use " * 3 + f"{i:03d} {base[i % 36][:40]}" for i in range(60)}
    for text in base * 4:
        chars = list(text)
        for _ in range(rng.randrange(1, 2 + len(text) // 25)):
            at, kind = rng.randrange(len(chars)), rng.randrange(3)
            chars[at:at + (kind != 0)] = [] if kind == 1 else [rng.choice("abé漢😀")]
        made.add("".join(chars))
    lines = sorted(made)
    df = materialize(spark.createDataFrame([(x,) for x in lines], "line string").withColumn("h", F.xxhash64("line")), "test-lines")
    text = {r.h: r.line for r in df.collect()}
    got = {frozenset((text[r.a], text[r.b])): r.distance for r in line_dedup.links(df, pairs=pairs).collect()}
    want = {}
    for i, a in enumerate(lines):
        for b in lines[i + 1:]:
            size = min(len(a), len(b))
            limit = max(min(size // 20, 2), size * 3 // 100)
            if abs(len(a) - len(b)) <= limit and (d := line_dedup._whole_distance(a, b)) <= limit:
                assert size > 150 or d == brute.levenshtein(a, b)
                want[frozenset((a, b))] = d
    assert got == want and max(want.values()) > 30 and sum(d > 2 for d in want.values()) > 30


def test_op3_short_lines_repeat_once(spark, sf_dir):
    seen, want = set(), {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id):
        for n, line in enumerate((r.text or "").split("\n") if r.text is not None else []):
            line = line.strip(" \t\n\x0b\x0c\r")
            if len(line) < 20:
                want[r.doc_id, n] = not line or line not in seen
                seen.add(line)
    got = {(r.doc_id, r.line_no): r.kept for r in LLM_QUERIES["op3_line_dedup"](spark, sf_dir).collect()}
    assert {k: got[k] for k in want} == want and not all(want.values())
