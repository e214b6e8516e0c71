"""Aliases in all the forms a page may name them, and a hub that a third of all pages point to."""

from __future__ import annotations

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from quillgrid.llm import url_filters

PAGE = "http://a.org/x/y/page?q=1"


@pytest.mark.parametrize("html, target", [
    ('<link rel="shortlink canonical" href="/b">', "/b"), ("<link href='/b' rel='canonical next'>", "/b"), ("<LINK REL=canonical HREF=/b>", "/b"),
    ('<link rel="canonical" href="?page=2">', "?page=2"), ('<link rel="canonical" href="../z">', "../z"), ('<link rel="canonical" href="./z/../w/.">', "./z/../w/."),
    ('<link rel="canonical" href="../../../../z">', "../../../../z"), ('<link rel="canonical" href="/c?a=1&#38;b=2&#x26;c=3&amp;d=4">', "/c?a=1&b=2&c=3&d=4"),
    ('<link rel="canonical" href="/&#233;">', "/é"), ('<meta http-equiv="refresh" content="0; url=../r">', "../r"), ('<link rel="canonical" href="http://B.org/./q">', "http://b.org/q"),
    ('<base href="/base/"><link rel="canonical" href="z">', "/base/z"), ('<base href="//c.org/d/"><link rel="canonical" href="?k">', "http://c.org/d/?k"),
])
def test_targets(spark, html, target):
    got = url_filters.page_edges(spark.createDataFrame([(1, PAGE, html)], "page_id long, url string, html string")).collect()
    assert [(r.a, r.b) for r in got] == [(PAGE, urljoin(PAGE, target))]


@pytest.mark.parametrize("html", ['<link rel="canonically" href="/b">', '<link rel="next" href="/canonical">', '<link rel="canonical" href="#top">', "<link rel=canonicals href=/b>"])
def test_no_other_links(spark, html):
    got = url_filters.page_edges(spark.createDataFrame([(1, PAGE, html)], "page_id long, url string, html string"))
    assert got.where("a <> b").count() == 0


def test_blocks_reach_aliases_of_a_hub(spark):
    rows = [(i, f"http://s{i}.net/p", '<link rel="shortlink canonical" href="http://bad.com/x/../de/hub">' if i % 3 == 0 else "") for i in range(900)]
    rows += [(1000, "http://bad.com/de/hub", None), (1001, "http://s0.net/p", "x"), (1001, "http://s0.net/p", "x"), (1002, "http://t.net/" + "q" * 5000, "<link rel=canonical href=/>" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(pages, [("block", "com/de/")]).collect()}
    assert {i for i, v in got.items() if v == "block"} == {i for i in range(900) if i % 3 == 0} | {1000, 1001}
    allowed = url_filters.judge_urls(pages, [("block", "com/de/"), ("allow", "s3.net/")])
    assert [r.page_id for r in allowed.where(F.col("verdict") == "block").collect()] == [1000]


def test_plan_of_links_stays_small(spark, capsys):
    pages = spark.createDataFrame([(1, PAGE, "")], "page_id long, url string, html string")
    edges = url_filters.page_edges(pages)
    edges.where("a <> b").select(F.greatest("a", "b"), F.least("a", "b")).distinct().explain("extended")
    assert len(capsys.readouterr().out) < 100_000
