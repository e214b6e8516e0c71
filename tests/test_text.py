import pytest
from pyspark.sql import functions as F

from quillgrid.functions.replies import class_name, prompt, read_reply
from quillgrid.functions.text import CLEANING_PATTERNS, clean_text, has_text, tokens, word_ngrams

CLEANED = [
    ("Hello <b>World</b>!", "hello world !"),
    ("See http://x.io/a?b=1 now", "see now"),
    ("www.site.com, ok", "ok"),
    ("Élan & co. — 50%", "lan co. 50"),
    ("don't  stop\t?", "don't stop ?"),
    ("日本", ""),
    ("a http://x.io b", "a b"),
]


def value(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize("text, expected", CLEANED)
def test_clean(spark, text, expected):
    assert value(spark, text, clean_text) == expected


ODD = [
    None, "", " ", " a ", "\t\n", "-", "--a--b--", "a-b", "é", "x\u00a0y\u3000z", "\U0001f600 a\U0001f600b \U0010ffff", "\x00a\x00", "\ufffd", "İIıſK",
    "<a", "a>b", "<p><b>x</b>", "<>x", "http", "http:// x", "wwwx y", "www\u2028z", "' . , ! ?", "'a'  'b'", "A\r\nB\x85C", "1,000.50", "a" * 5000 + "é" * 5000,
]


def test_clean_is_what_all_patterns_leave(spark):
    plain = F.lower("t")
    for pattern in CLEANING_PATTERNS:
        plain = F.regexp_replace(plain, pattern, " ")
    rows = spark.createDataFrame([(t,) for t in [*ODD, *ODD]], "t string").select("t", clean_text(F.col("t")).alias("got"), F.trim(plain).alias("want")).collect()
    assert len(rows) == 2 * len(ODD) and [r for r in rows if r.got != r.want] == []


@pytest.mark.parametrize("kind, expected", [
    ("default", ["don", "stop", "ab", "3d", "x9y"]),
    ("strict", ["don", "stop", "x9y"]),
    ("space", ["don't", "stop", "ab", "3d", "x9y"]),
])
def test_tokens(spark, kind, expected):
    assert value(spark, "don't stop ab 3d x9y", lambda t: tokens(t, kind)) == expected


@pytest.mark.parametrize("kind", ["default", "strict", "space"])
def test_no_tokens_in_empty_text(spark, kind):
    assert value(spark, "", lambda t: tokens(t, kind)) == []


@pytest.mark.parametrize("words, low, high, expected", [
    ("a b c", 1, 2, ["a", "b", "c", "a b", "b c"]),
    ("a b c", 2, 3, ["a b", "b c", "a b c"]),
    ("a b", 3, 3, []),
    ("a", 2, 3, []),
    ("", 1, 3, []),
])
def test_ngrams(spark, words, low, high, expected):
    assert value(spark, words, lambda t: word_ngrams(tokens(t, "space"), low, high)) == expected


@pytest.mark.parametrize("text, expected", [("   \t", False), ("", False), (" a", True)])
def test_blank(spark, text, expected):
    assert value(spark, text, has_text) is expected


CLASSES = ("business", "entertainment", "politics", "sport", "tech")


@pytest.mark.parametrize("reply, name, status", [
    (" Sport ", "sport", "exact"),
    ("This is about tech and business", "business", "contains"),
    ("Poli-sci", "politics", "prefix"),
    ("unknown", None, "default"),
    ("", None, "default"),
    (None, None, "error"),
])
def test_replies(spark, reply, name, status):
    answer = value(spark, reply, lambda t: read_reply(t, CLASSES))
    assert (answer.class_name, answer.status) == (name, status)
    assert answer.class_index == (CLASSES.index(name) if name else None)


def test_prompt_is_cut_to_words(spark):
    text = value(spark, " ".join(f"w{i}" for i in range(300)), lambda t: prompt(t, CLASSES, 256))
    assert "w255" in text and "w256" not in text
    assert "categories: business, entertainment, politics, sport, tech." in text


@pytest.mark.parametrize("label, name", [("0", "politics"), ("4", "business"), ("7", "7"), ("en", "en"), ("0.0", "0.0")])
def test_class_names(spark, label, name):
    assert value(spark, label, class_name) == name
