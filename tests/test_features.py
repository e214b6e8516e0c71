import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgrid.operators.cache import FeatureCache, fingerprint
from quillgrid.operators.features import TermFeatures, as_vectors, tfidf
from quillgrid.operators.vocabulary import term_stats, top_terms
from quillgrid.session import broadcast_if_small, scratch_path

DOCS = [(1, "red red blue"), (2, "blue green"), (3, "unknown words"), (4, "")]


def frame(spark, docs=DOCS):
    return spark.createDataFrame(docs, "doc_id long, text_clean string")


def cells(df, key="doc_id"):
    return {(r[key], r.term): r.value for r in df.collect()}


def test_vocabulary_ties_go_by_term(spark):
    df = spark.createDataFrame([(["b", "a", "c", "c"],), (["a", "b"],)], "tokens array<string>")
    rows = top_terms(term_stats(df), 2).orderBy("term_id").collect()
    assert [(r.term, r.ctf, r.df) for r in rows] == [("a", 2, 2), ("b", 2, 2)]


def test_hot_term_counts(spark):
    df = spark.range(2000).select(F.array(F.lit("hot"), F.lit("hot"), F.col("id").cast("string")).alias("tokens"))
    hot = term_stats(df.repartition(16)).where("term = 'hot'").first()
    assert (hot.ctf, hot.df) == (4000, 2000)


def test_counts_ignore_unknown_terms(spark):
    model = TermFeatures("bow", (1, 1), 10, False).fit(frame(spark, DOCS[:2]))
    assert cells(model.transform_long(frame(spark))) == {
        (1, "red"): 2.0, (1, "blue"): 1.0, (2, "blue"): 1.0, (2, "green"): 1.0
    }


def brute_force_tfidf(train, docs, low, high, cap):
    def terms(text):
        words = re.findall("[a-z0-9]{2,}", text)
        return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]

    ctf, df = Counter(), Counter()
    for text in train:
        ctf.update(terms(text))
        df.update(set(terms(text)))
    kept = sorted(ctf, key=lambda t: (-ctf[t], t))[:cap]
    idf = {t: math.log((1 + len(train)) / (1 + df[t])) + 1 for t in kept}
    result = {}
    for key, text in docs:
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in Counter(terms(text)).items() if t in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        result.update({(key, t): x / norm for t, x in raw.items()})
    return result


@pytest.mark.parametrize("low, high, cap", [(1, 2, 500), (2, 3, 50)])
def test_tfidf_against_brute_force(spark, divided, low, high, cap):
    sample = divided.select("doc_id", "text_clean", "split")
    got = cells(TermFeatures("x", (low, high), cap, True).fit(sample.where("split = 'train'")).transform_long(sample))
    rows = sample.collect()
    expected = brute_force_tfidf(
        [r.text_clean for r in rows if r.split == "train"], [(r.doc_id, r.text_clean) for r in rows], low, high, cap
    )
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_rows_have_unit_length_in_any_partitioning(spark, divided):
    model = tfidf().fit(divided.where("split = 'train'").repartition(7))
    long = model.transform_long(divided.repartition(5))
    norms = long.groupBy("doc_id").agg(F.sum(F.col("value") ** 2).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in norms)
    again = tfidf().fit(divided.where("split = 'train'").repartition(2)).transform_long(divided)
    assert cells(again).keys() == cells(long).keys()


def test_transform_has_no_shuffle(spark, divided):
    model = tfidf().fit(divided.where("split = 'train'"))
    plan = model.transform(divided)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema" in plan


def test_vectors_round_trip(spark):
    model = TermFeatures("bow", (1, 1), 10, False).fit(frame(spark, DOCS[:2]))
    vectors = {r.doc_id: r.features for r in as_vectors(model.transform(frame(spark))).collect()}
    assert vectors[4].numNonzeros() == 0 and vectors[1].size == 3
    assert sorted(vectors[1].values) == [1.0, 2.0]


def test_cache_sees_changes(spark, divided):
    cache = FeatureCache(scratch_path(spark, "test-cache"))
    extractor = TermFeatures("bow", (1, 1), 50, False)
    first, hit = cache.load_or_extract(divided, extractor)
    assert not hit and first.count() == divided.count()
    assert cache.load_or_extract(divided.repartition(3), extractor)[1]
    assert not cache.load_or_extract(divided, TermFeatures("bow", (1, 1), 51, False))[1]
    changed = divided.withColumn("text_clean", F.when(F.col("split") == "val", F.lit("x")).otherwise(F.col("text_clean")))
    assert cache.digest(changed) != cache.digest(divided)


def test_fingerprint_counts_equal_rows(spark):
    row = (1, "a", "text", "train")
    schema = "doc_id int, label string, text_clean string, split string"
    once, twice = (fingerprint(spark.createDataFrame([row] * n, schema)).first() for n in (1, 2))
    assert once.digest != twice.digest and (once.n_rows, twice.n_rows) == (1, 2)


def test_broadcast_only_below_the_limit(spark):
    def plan(limit):
        left, right = spark.range(1000), spark.range(100)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            return left.join(broadcast_if_small(right, limit), "id")._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    assert "BroadcastHashJoin" in plan(100) and "SortMergeJoin" in plan(99)


def test_term_counts_of_rows_and_repeated_ids(spark):
    """Counts equal those of an aggregate; rows under an id of their own are not shuffled."""
    from quillgrid.operators.vocabulary import term_counts

    rows = [(1, ["b", "a", "b"]), (2, []), (3, ["c"]), (4, None), (None, ["x", "y"]), (None, ["x"]), (5, ["a", "a"]), (5, ["a", "z"])]
    for chosen in (rows, rows[:4]):
        df = spark.createDataFrame(chosen, "doc_id long, tokens array<string>")
        want = df.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
        got = term_counts(df, "doc_id")
        assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_large_corpora_are_counted_in_more_tasks(divided, monkeypatch):
    from quillgrid.operators import features

    train, seen, count = divided.where("split = 'train'"), [], features.term_stats
    before = train.sparkSession.conf.get("spark.sql.shuffle.partitions")

    def noted(df):
        seen.append((df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        return count(df)

    monkeypatch.setattr(features, "term_stats", noted)
    one = features.ngram().fit(train)
    monkeypatch.setattr(features, "TASK_CHARS", 20_000)
    several = features.ngram().fit(train)
    chars = train.selectExpr("sum(length(text_clean)) AS n").first().n
    assert min(seen[1]) >= 2 * chars / 20_000 > max(seen[0])
    assert one.rows == several.rows and one.documents == several.documents
    assert train.sparkSession.conf.get("spark.sql.shuffle.partitions") == before
