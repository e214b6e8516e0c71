from pyspark.sql import functions as F

from quillgrid.operators.compare import best_per_group, speedup_table, strong_scaling, union_runs
from quillgrid.operators.features import TermFeatures
from quillgrid.operators.naive_bayes import fit_naive_bayes
from quillgrid.operators.zero_shot import class_list, classify, hard_probability
from quillgrid.plans.analysis import run_all
from quillgrid.plans.grid import run_grid
from quillgrid.plans.queries import LANGUAGES, load_stop_word_model
from quillgrid.plans.registry import EXTRACTORS, MODELS
from quillgrid.sources.runs import RUN_SCHEMA


def broken(train, val):
    raise ValueError("no model here\nsecond line")


class BrokenExtractor:
    name = "broken"

    def fit(self, train):
        raise RuntimeError("no features here")


def test_grid_goes_on_after_failures(spark, divided):
    runs = run_grid(
        divided,
        extractors={"bow": TermFeatures("bow", (1, 1), 200, False), "broken": BrokenExtractor()},
        fits={"naive_bayes": lambda train, val: fit_naive_bayes(train), "broken": broken},
        generators={"stop_words": load_stop_word_model},
        parallel_cells=2,
    )
    assert runs.schema == RUN_SCHEMA
    rows = {(r.feature, r.model): r for r in runs.collect()}
    good = rows[("bow", "naive_bayes")]
    assert good.error is None and good.test_f1_macro > 0.5 and good.train_time > 0 and good.val_accuracy > 0.5
    assert rows[("bow", "broken")].error == "ValueError: no model here"
    assert rows[("broken", "naive_bayes")].error == "RuntimeError: no features here"
    assert rows[("broken", "broken")].test_accuracy is None
    assert rows[("raw_text", "stop_words")].test_accuracy > 0.3 and len(rows) == 5


def test_all_variants_are_run_and_compared(spark, divided, tmp_path):
    tables = run_all(
        divided, str(tmp_path), extractors={"bow": TermFeatures("bow", (1, 1), 100, False)},
        fits={"naive_bayes": lambda train, val: fit_naive_bayes(train), "broken": broken},
    )
    assert {(r.pipeline, r.model) for r in tables["summary"].collect()} == {("default", "naive_bayes"), ("optimized", "naive_bayes")}
    speed = {r.pipeline: r.speedup_vs_serial for r in tables["speedup"].collect()}
    assert speed["default"] == 1.0 and speed["optimized"] > 0
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 4


def test_registries_cover_the_grid():
    for variant in ("default", "optimized"):
        assert list(EXTRACTORS[variant]) == ["bow", "tfidf", "ngram", "word2vec", "doc2vec"]
        assert len(MODELS[variant]) == 7
    assert EXTRACTORS["optimized"]["bow"]().token_kind == "strict"


def test_failed_batch_is_an_error_not_a_class(spark):
    def load_flaky():
        return lambda prompts: [] if any("bad" in p for p in prompts) else ["fr"] * len(prompts)

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "doc_id int, text_clean string").coalesce(1)
    rows = {r.doc_id: r for r in hard_probability(classify(df, LANGUAGES, load_flaky, batch_size=1), 4).collect()}
    assert (rows[1].class_name, rows[1].status, rows[1].probability) == ("fr", "exact", [0.0, 0.0, 0.0, 1.0])
    assert (rows[2].prediction, rows[2].status, rows[2].probability) == (None, "error", [0.0] * 4)


def test_class_list_uses_names(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (7, 2)], "label int, label_enc int")
    assert class_list(df) == ["politics", "sport", "7"]


def test_strong_scaling_example(spark):
    points = spark.createDataFrame([(4, 40.0), (1, 100.0), (2, 60.0)], "x int, total_time double")
    rows = [(r.x, round(r.speedup, 6), r.ideal, round(r.efficiency, 6)) for r in strong_scaling(points).collect()]
    assert rows == [(1, 1.0, 1.0, 1.0), (2, 1.666667, 2.0, 0.833333), (4, 2.5, 4.0, 0.625)]


def test_speedup_without_baseline(spark):
    df = spark.createDataFrame([("parallel", 90.0)], "p string, t double")
    row = speedup_table(df, "p", "t", "serial").first()
    assert (row.total_time_min, row.speedup_vs_serial) == (1.5, None)


def test_best_of_a_hot_group_with_ties(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("g"), (F.col("id") % 10).cast("double").alias("s"), "id"
    ).union(spark.createDataFrame([("none", None, 1)], "g string, s double, id long"))
    rows = {r.g: (r.id, r.s) for r in best_per_group(df, "g", "s", ["id"], ["id", "s"]).collect()}
    assert rows == {"hot": (19, 9.0), "rare": (9, 9.0)}


def test_union_fills_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("e",)], "error string")
    assert [tuple(r) for r in union_runs(a, b).collect()] == [(1, None), (None, "e")]


def test_a_journal_goes_on_where_the_grid_stopped(divided, tmp_path):
    """Cells that ran are taken from the journal, failed and missing ones run."""
    runs = []

    def fit(name, fails=False):
        def work(train, val):
            runs.append(name)
            if fails:
                raise ValueError("lost")
            return fit_naive_bayes(train)

        return work

    journal = f"file://{tmp_path}/journal"
    again = {"extractors": {"bow": TermFeatures("bow", (1, 1), 100, False)}, "use_cache": False, "journal": journal}
    first = run_grid(divided, fits={"a": fit("a"), "b": fit("b", True)}, **again).collect()
    assert [r.error is None for r in first] == [True, False] and runs == ["a", "b"]
    runs.clear()
    second = run_grid(divided, fits={"a": fit("a"), "b": fit("b"), "c": fit("c")}, **again).collect()
    assert runs == ["b", "c"] and {r.model for r in second} == {"a", "b", "c"} and all(r.error is None for r in second)
    assert [r.test_f1_macro for r in second if r.model == "a"] == [first[0].test_f1_macro]
    runs.clear()
    assert len(run_grid(divided, fits={"a": fit("a"), "b": fit("b"), "c": fit("c")}, **again).collect()) == 3 and not runs
