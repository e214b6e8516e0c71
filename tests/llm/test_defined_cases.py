"""Nulls, empty and long texts, repeated rows, empty tables and columns with clashing names, for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillgrid.llm import chat, contamination, language, line_dedup, personal_data, pieces, quality, simhash, url_filters, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, items string, h string, lang_pred string, line string, component_id string"
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it", "en"), (1, "the quick brown fox jumps over the lazy dog and runs away from it", "en"),
    (2, None, "en"), (None, "one text without any id but with a few words in it", None), (3, "", "fr"), (4, "le " * 30000, "fr"), (5, "x" * 50000, None), (6, "1234 !!!", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, l, "s", 1, 0.5, "k", "i", "h", "p", "l", "c") for i, t, l in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs away from it", "x"), (None, None, "x")], "item_id long, text string, kept string")


def operators(bench):
    return {
        "lines": line_dedup.line_classes, "fewer_lines": line_dedup.remove_repeated_lines, "pieces": pieces.encode,
        "contamination": lambda d: contamination.decontaminate(d, bench), "simhash": simhash.near_duplicates,
        "personal": personal_data.find_personal_data, "quality": quality.judge, "language": language.identify,
    }


@pytest.mark.parametrize("name", sorted(operators(None)))
def test_operator(name, docs, bench):
    operator = operators(bench)[name]
    got = operator(docs).collect()
    if name == "lines":
        assert len(got) == 7  # the null text has no lines
    else:
        assert len(got) == len(TEXTS)
    assert operator(docs.limit(0)).count() == 0


def test_results_of_odd_documents(docs, bench):
    languages = {(r.doc_id, r.lang_pred) for r in language.identify(docs).collect()}
    assert {(2, "und"), (3, "und"), (6, "und"), (4, "fr")} <= languages
    dirty = [r.doc_id for r in contamination.decontaminate(docs, bench).where("contaminated").collect()]
    assert dirty == [1, 1]
    judged = {(r.doc_id, r.kept) for r in quality.judge(docs).collect()}
    assert (2, False) in judged and (3, False) in judged
    parts = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert parts[2] == parts[3] == 2


def test_no_training_and_no_benchmark(spark, docs, bench):
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(blank).collect()} == {"und"}
    assert contamination.decontaminate(docs, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_empty_pages_and_conversations(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, rule string")
    assert warc.archive_round_trip(spark, pages).count() == 0
    assert url_filters.judge_urls(pages, []).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_conversations(chat.format_windows(turns)).count() == 0
    named = spark.createDataFrame([(None, None, None, "r")], "page_id long, url string, html string, rule string")
    assert [tuple(r)[:5] for r in url_filters.judge_urls(named, [("block", "a/")]).collect()] == [(None, "", "", None, "allow")]
    assert [(r.record_id, r.url, r.payload_bytes, r.record_type) for r in warc.archive_round_trip(spark, named).collect()] == [(None, None, 0, "response")]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage(stage, spark, docs, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    function = dict(corpus_pipeline.STAGES)[stage]
    got = function(spark, docs, str(tmp_path))
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == docs.columns
    want = {
        "language_id": [None, 1, 1, 4, 5], "line_dedup": [None, 1, 1, 2, 3, 4, 5, 6], "simhash_near_dedup": [None, 1, 2, 4, 5, 6],
        "benchmark_decontamination": [None, 2, 3, 4, 5, 6], "sentencepiece": [None, 1, 1, 2, 3, 4, 5, 6],
    }[stage]
    assert sorted((r.doc_id for r in got.collect()), key=lambda i: (i is not None, i)) == want
    assert function(spark, docs.limit(0), str(tmp_path)).count() == 0
