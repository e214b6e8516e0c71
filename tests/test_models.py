import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quillgrid.operators import classifiers
from quillgrid.operators.evaluate import classification_report, evaluate
from quillgrid.operators.naive_bayes import fit_naive_bayes, smallest_value
from quillgrid.operators.neighbours import dense_parts, nearest_neighbours, sparse_parts, vote, vote_shares


@pytest.fixture(scope="module")
def parts(stored):
    return {name: stored.where(F.col("split") == name) for name in ("train", "val", "test")}


MODELS = {
    "logistic_regression": lambda p: classifiers.fit_logistic_regression(p["train"]),
    "random_forest": lambda p: classifiers.fit_random_forest(p["train"], trees=20),
    "boosted_trees": lambda p: classifiers.fit_boosted_trees(p["train"], rounds=3),
    "boosted_trees_early_stop": lambda p: classifiers.fit_boosted_trees_early_stop(p["train"], p["val"], rounds=3),
    "svm": lambda p: classifiers.fit_linear_svm(p["train"]),
    "svm_calibrated": lambda p: classifiers.fit_calibrated_svm(p["train"]),
    "naive_bayes": lambda p: fit_naive_bayes(p["train"]),
    "knn": lambda p: classifiers.fit_neighbours(p["train"]),
    "mlp": lambda p: classifiers.fit_mlp(p["train"], hidden=(16,), max_iter=60),
}


@pytest.mark.parametrize("name", sorted(MODELS))
def test_model_beats_the_majority(parts, name):
    scored = MODELS[name](parts).transform(parts["test"])
    rows = scored.select("label_enc", "prediction", vector_to_array("probability").alias("p")).collect()
    assert len(rows) == parts["test"].count()
    for r in rows:
        assert abs(sum(r.p) - 1) < 1e-6 and min(r.p) >= 0 and len(r.p) == 4
        assert r.p[int(r.prediction)] == pytest.approx(max(r.p))
    majority = max(np.bincount([r.label_enc for r in rows])) / len(rows)
    assert np.mean([r.label_enc == r.prediction for r in rows]) > majority + 0.1


def test_best_round_is_not_the_last():
    assert classifiers.best_round([0.9, 0.5, 0.6, 0.4, 0.7, 0.7, 0.7], 3) == (4, True)
    assert classifiers.best_round([0.9, 0.5, 0.6, 0.4, 0.7, 0.7], 3) == (4, False)
    assert classifiers.best_round([0.9, 0.5, 0.6, 0.6, 0.4], 2) == (2, True)


def test_early_stopping_keeps_the_best_rounds(parts):
    model = classifiers.fit_boosted_trees_early_stop(parts["train"], parts["val"], rounds=6, depth=3, patience=2)
    assert len(model.trees) == int(np.argmin(model.losses)) + 1 <= model.rounds_fitted <= 6


def test_block_gives_k_rows_per_query():
    import pandas as pd

    from quillgrid.operators import neighbours

    rng = __import__("numpy").random.default_rng(0)
    def rows(n):
        return pd.DataFrame({"id": range(n), "label": [0] * n, "size": [4] * n, "indices": [None] * n, "values": list(rng.random((n, 4)))})
    for n in (3, 2_000):
        found = neighbours._nearest_in_block(5)(rows(7), rows(n))
        assert found.groupby("id").size().tolist() == [min(5, n)] * 7


def test_complement_weights(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(0, [3.0, 0.0, 1.0]), (1, [0.0, 2.0, 1.0]), (1, [1.0, 1.0, 0.0]), (2, [0.0, 0.0, 4.0])]
    df = spark.createDataFrame([(y, Vectors.dense(x)) for y, x in rows], ["label_enc", "features"])
    got = [r[0] for r in fit_naive_bayes(df).transform(df).select(vector_to_array("probability")).collect()]
    x = np.array([r[1] for r in rows])
    y = np.array([r[0] for r in rows])
    rest = np.array([x[y != c].sum(axis=0) + 1 for c in range(3)])
    score = x @ -np.log(rest / rest.sum(axis=1, keepdims=True)).T
    expected = np.exp(score - score.max(axis=1, keepdims=True))
    assert np.allclose(got, expected / expected.sum(axis=1, keepdims=True))


def test_smallest_value_counts_absent_entries(spark):
    from pyspark.ml.linalg import Vectors

    def least(*vectors):
        return smallest_value(spark.createDataFrame([(v,) for v in vectors], ["features"]))

    assert least(Vectors.sparse(3, [0], [2.0])) == 0.0
    assert least(Vectors.dense([2.0, 3.0])) == 2.0
    assert least(Vectors.dense([-2.0, 3.0]), Vectors.sparse(2, [], [])) == -2.0


def brute_force(queries, train, k):
    def unit(rows):
        m = np.array([r[1] for r in rows], float)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n > 0, n, 1)

    distance = np.round(1 - unit(queries) @ unit(train).T, 9)
    return {
        q[0]: [t for _, t in sorted(zip(distance[i], [t[0] for t in train]))[:k]] for i, q in enumerate(queries)
    }


@pytest.mark.parametrize("block_rows", [7, 64, 10_000])
def test_neighbours_in_blocks_of_any_size(spark, block_rows):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], int(i % 3)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int").select("id", "label", *dense_parts(F.col("v")))
    queries, train = df.where("id < 30"), df.where("id >= 30")
    near = nearest_neighbours(queries, train, 5, block_rows)
    got = {}
    for r in near.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.train_id)
    assert got == brute_force(rows[:30], rows[30:], 5)
    shares = vote_shares(near).groupBy("id").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in shares) and len(shares) == 30


def test_sparse_and_dense_rows_agree(spark, stored):
    queries, train = stored.where("split = 'test'"), stored.where("split = 'train'")

    def parts(df, kind):
        v = F.unwrap_udt("features")
        columns = sparse_parts(v) if kind == "sparse" else dense_parts(vector_to_array("features"))
        return df.select(F.col("doc_id").alias("id"), F.col("label_enc").alias("label"), *columns)

    found = [
        {(r.id, r.rank): r.train_id for r in nearest_neighbours(parts(queries, k), parts(train, k), 5, 50).collect()}
        for k in ("sparse", "dense")
    ]
    assert found[0] == found[1] and len(found[0]) == queries.count() * 5


def test_tied_vote_takes_the_smallest_class(spark):
    near = spark.createDataFrame([(1, 3), (1, 3), (1, 2), (1, 2), (1, 5)], "id long, label int")
    assert vote(near).first().prediction == 2


def test_evaluation_example(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "truth int, prediction int")
    scores = evaluate(df).first()
    assert (scores.accuracy, round(scores.f1_macro, 6), round(scores.f1_weighted, 6)) == (0.6, 0.433333, 0.52)


def test_evaluation_agrees_with_spark(spark):
    df = spark.range(500).select((F.col("id") % 4).alias("truth"), (F.col("id") * 7 % 5 % 4).alias("prediction"))
    scores = evaluate(df).first()
    doubles = df.select(*[F.col(c).cast("double") for c in df.columns])
    for metric, ours in (("accuracy", scores.accuracy), ("f1", scores.f1_weighted)):
        check = MulticlassClassificationEvaluator(labelCol="truth", metricName=metric).evaluate(doubles)
        assert ours == pytest.approx(check)


def test_macro_f1_covers_predicted_classes_and_missing_predictions(spark):
    df = spark.createDataFrame([(0, 0), (0, 9), (1, None)], "truth int, prediction int")
    scores = evaluate(df).first()
    assert scores.accuracy == pytest.approx(1 / 3)
    assert scores.f1_macro == pytest.approx((2 / 3 + 0 + 0) / 3)


def test_report_lists_absent_classes(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "truth int, prediction int")
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "class int, name string")
    rows = {r["class"]: r for r in classification_report(df, names).collect()}
    assert set(rows) == {"a", "b", "c", "accuracy", "macro avg", "weighted avg"}
    assert (rows["c"].support, rows["c"].f1, rows["a"].precision, rows["accuracy"].f1) == (0, 0.0, 0.5, 0.5)
