"""Registered queries: each runs one operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillgrid import settings
from quillgrid.functions.replies import class_name, prompt, read_reply
from quillgrid.functions.text import clean_text, pattern_tokens, space_tokens, tokens, word_ngrams
from quillgrid.operators import classifiers, compare, features, neighbours
from quillgrid.operators.cache import FeatureCache, fingerprint
from quillgrid.operators.document_vectors import DocumentVectorFeatures
from quillgrid.operators.evaluate import classification_report, evaluate
from quillgrid.operators.naive_bayes import fit_naive_bayes
from quillgrid.operators.prepare import corpus_profile, encode_labels, label_dictionary, prepare_corpus
from quillgrid.operators.split import sample_rows, stratified_folds, stratified_split
from quillgrid.operators.vocabulary import term_counts, term_stats, top_terms
from quillgrid.operators.word_vectors import mean_word_vectors, train_word_vectors
from quillgrid.operators.zero_shot import classify, evaluate_sample, hard_probability
from quillgrid.plans.grid import grid_cells, run_cell, run_grid, split_corpus
from quillgrid.session import materialize, scratch_path, spread_rows
from quillgrid.sinks.runs import export_runs, write_csv
from quillgrid.sources.delimited import (
    Layout, column_profile, infer_columns, is_header, load_corpus, scan_delimited, separator_of,
)
from quillgrid.sources.runs import (
    RUN_SCHEMA, pipeline_of, scan_runs as read_runs, scan_scaling as read_scaling, scored_runs, total_time, typed_runs,
)

LANGUAGES = ("de", "en", "es", "fr")
REPLY_CLASSES = ("business", "entertainment", "politics", "sport", "tech")
DIGITS = 6
# Tables with much work per row.
TEXT_TABLES = ("documents", "pages", "conversations")

_split_corpora: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_rows(df) if name in TEXT_TABLES else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_corpus(table(spark, sf_dir, "documents"), "text", "lang", "doc_id")


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split corpus, stored once per session as in the grid."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _split_corpora:
        _split_corpora[key] = split_corpus(corpus(spark, sf_dir))
    return _split_corpora[key]


def training(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


# --- scans ---------------------------------------------------------------


def scan_corpus(spark, sf_dir):
    path = scratch_path(spark, "corpus-csv")
    table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"), "text").write.csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return load_corpus(spark, path, "doc_id").select("doc_id", "label", "text")


def sniff_separator(spark, sf_dir):
    mark = F.when(F.col("o_custkey") % 2 == 0, "\t").otherwise(",")
    cells = [F.col(c).cast("string") for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")]
    line = F.concat(cells[0], mark, cells[1], mark, cells[2])
    return table(spark, sf_dir, "orders").select("o_orderkey", separator_of(line).alias("separator"))


def detect_header(spark, sf_dir):
    first = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit('"-'), F.col("p_size").cast("string"), F.lit('"')))
    line = F.concat_ws(",", first, "p_brand", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", is_header(line, ",").alias("is_header"))


def scan_bad_rows(spark, sf_dir):
    path = scratch_path(spark, "bad-rows")
    key = F.col("o_orderkey").cast("string")
    line = (
        F.when(F.col("o_custkey") % 5 == 0, F.concat_ws(",", key, "o_orderstatus", "o_orderpriority", F.lit("extra")))
        .when(F.col("o_custkey") % 7 == 0, F.concat_ws(",", key, "o_orderstatus"))
        .when(F.col("o_custkey") % 11 == 0, F.concat_ws(",", key, F.lit("NA"), "o_orderpriority"))
        .otherwise(F.concat_ws(",", key, "o_orderstatus", F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('""\n,"'))))
    )
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    return scan_delimited(spark, path, Layout(",", False, ("id", "status", "priority")))


def scan_headerless(spark, sf_dir):
    """No header and no layout given: both are found, and columns are numbered."""
    path = scratch_path(spark, "headerless")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    return scan_delimited(spark, path)


def infer_column_roles(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    text, label = infer_columns(df)
    role = F.when(F.col("column") == text, "text").when(F.col("column") == label, "label").otherwise("none")
    return rounded(column_profile(df, df.columns).withColumn("role", role), "mean_length")


# --- run files, with runs that are aggregates of lineitem -----------------


def lineitem_runs(spark, sf_dir):
    failed = (F.max("l_linenumber") == 7) & (F.max("l_linestatus") == "O")
    def share(condition):
        return F.avg(condition.cast("double"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("pipeline"), F.col("l_linestatus").alias("feature"),
            F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"),
        )
        .agg(
            F.max("l_quantity").alias("feature_fit_transform_time"),
            (F.sum("l_quantity") / 1000).alias("train_time"),
            F.when(~failed, share(F.col("l_discount") > 0.05)).alias("test_accuracy"),
            F.when(~failed, share(F.col("l_tax") > 0.04)).alias("test_f1_macro"),
            F.when(failed, "failed").alias("error"),
        )
    )


def lineitem_totals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("pipeline")).agg(F.sum("l_quantity").alias("total_time"))


def _export_runs(spark, sf_dir):
    runs = materialize(lineitem_runs(spark, sf_dir), "runs")
    totals = materialize(lineitem_totals(spark, sf_dir), "totals")
    folder = scratch_path(spark, "results")
    for (name,) in totals.select("pipeline").collect():
        meta = totals.where(F.col("pipeline") == name).select(
            F.lit(0).alias("place"), F.format_string("total_time: %.4f", "total_time").alias("line")
        )
        export_runs(runs.where(F.col("pipeline") == name), f"{folder}/results_{name}.txt", meta)
    return folder


def runs_csv(spark, sf_dir):
    """The summary as CSV and back."""
    path = scratch_path(spark, "summary-csv")
    numbers = ("feature_fit_transform_time", "train_time", "test_accuracy", "test_f1_macro")
    write_csv(lineitem_runs(spark, sf_dir), path)
    stored = spark.read.csv(path, header=True)
    return stored.select("pipeline", "feature", "model", *[F.round(F.col(c).cast("double"), DIGITS).alias(c) for c in numbers], "error")


def _scanned(spark, sf_dir):
    meta, cells = read_runs(spark, f"{_export_runs(spark, sf_dir)}/results_*.txt")
    return meta, typed_runs(cells, pipeline_of(F.col("path")))


def scan_runs(spark, sf_dir):
    return _scanned(spark, sf_dir)[1].select(
        "pipeline", "feature", "model", "feature_fit_transform_time", "train_time", "test_accuracy", "test_f1_macro", "error"
    )


def runs_typed(spark, sf_dir):
    return scored_runs(_scanned(spark, sf_dir)[1]).select("pipeline", "feature", "model", "test_accuracy", "test_f1_macro")


def runs_tagged(spark, sf_dir):
    meta, runs = _scanned(spark, sf_dir)
    times = meta.select(pipeline_of(F.col("path")).alias("pipeline"), total_time("meta").alias("total_time"))
    return runs.groupBy("pipeline").agg(F.count("*").alias("n_rows")).join(times, "pipeline")


def runs_export(spark, sf_dir):
    lines = spark.read.text(f"{_export_runs(spark, sf_dir)}/results_*.txt")
    return lines.select(pipeline_of(F.input_file_name()).alias("pipeline"), F.col("value").alias("line"))


def runs_union(spark, sf_dir):
    runs = lineitem_runs(spark, sf_dir)
    parts = [
        runs.where("pipeline = 'A'").drop("error"),
        runs.where("pipeline = 'N'").drop("train_time", "feature_fit_transform_time"),
        runs.where("pipeline = 'R'"),
    ]
    return rounded(
        compare.union_runs(*parts).select("pipeline", "feature", "model", "train_time", "test_accuracy", "error"),
        "train_time", "test_accuracy",
    )


def scan_scaling(spark, sf_dir):
    points = materialize(
        table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("x")).agg(F.sum("l_quantity").alias("t")), "points"
    )
    folder = scratch_path(spark, "scaling")
    for (x,) in points.select("x").collect():
        key = "total_wall_time" if x % 2 else "total_time"
        points.where(F.col("x") == x).select(F.format_string(f"{key}: %.4f", "t").alias("value")).coalesce(1).write.text(
            f"{folder}/njobs_{x}/results_parallel.txt"
        )
    return read_scaling(spark, folder)


# --- preparation ----------------------------------------------------------


def prepare(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", "label", F.length("text_clean").alias("n_clean_chars"))


def cleaned_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean_text(F.col("text")).alias("text_clean"))


def cleaned_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", clean_text(F.col("html")).alias("text_clean"))


def label_encode(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label"))
    return encode_labels(df, materialize(label_dictionary(df), "labels"))


def class_names(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", class_name(F.col("label")).alias("class_name"))


def profile(spark, sf_dir):
    return corpus_profile(corpus(spark, sf_dir))


def split(spark, sf_dir):
    return stratified_split(corpus(spark, sf_dir)).select("doc_id", "split")


def folds(spark, sf_dir):
    return stratified_folds(corpus(spark, sf_dir), "label", "doc_id", 3).select("doc_id", "fold")


def sample_n(spark, sf_dir):
    return sample_rows(corpus(spark, sf_dir), "doc_id", 500).select("doc_id")


# --- text -----------------------------------------------------------------


def _token_query(kind: str):
    def query(spark, sf_dir):
        return corpus(spark, sf_dir).select("doc_id", F.posexplode(tokens(F.col("text_clean"), kind)).alias("pos", "token"))

    return query


def ngram_counts(spark, sf_dir):
    words = corpus(spark, sf_dir).withColumn("w", pattern_tokens(F.col("text_clean")))
    grams = words.select("doc_id", word_ngrams(F.col("w"), 2, 3).alias("tokens"))
    return term_counts(grams, "doc_id").withColumnRenamed("term", "ngram")


def _terms(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", pattern_tokens(F.col("text_clean")).alias("tokens"))


def term_statistics(spark, sf_dir):
    return term_stats(_terms(spark, sf_dir))


def vocabulary(spark, sf_dir):
    return top_terms(term_stats(_terms(spark, sf_dir)), 20_000)


# --- features -------------------------------------------------------------


def _feature_query(extractor: features.TermFeatures):
    def query(spark, sf_dir):
        df = split_documents(spark, sf_dir)
        return rounded(extractor.fit(training(df)).transform_long(df), "value")

    return query


def bow_transform(spark, sf_dir):
    """A vocabulary of other texts; words it lacks are left out."""
    known = table(spark, sf_dir, "benchmark").select(clean_text(F.col("text")).alias("text_clean"))
    return features.bow().fit(known).transform_long(corpus(spark, sf_dir))


def feature_cache(spark, sf_dir):
    df = split_documents(spark, sf_dir)
    cache = FeatureCache(scratch_path(spark, "feature-cache"))
    cache.load_or_extract(df, features.bow())
    stored, hit = cache.load_or_extract(df, features.bow())
    if not hit:
        raise RuntimeError("stored features were not found again")
    vector = stored.select("doc_id", "split", F.unwrap_udt("features").alias("v"))
    cells = vector.select("doc_id", "split", F.explode(F.arrays_zip("v.indices", "v.values")).alias("cell"))
    return cells.select("doc_id", "split", F.col("cell.indices").alias("term_id"), F.col("cell.values").alias("value"))


def feature_fingerprint(spark, sf_dir):
    return fingerprint(split_documents(spark, sf_dir))


def w2v_doc_mean(spark, sf_dir):
    """Word vectors: the embedding whose id is the rank of the term."""
    df = split_documents(spark, sf_dir)
    ranked = top_terms(term_stats(df.select(space_tokens(F.col("text_clean")).alias("tokens"))), 20_000)
    vectors = table(spark, sf_dir, "embeddings").join(ranked, F.col("vec_id") == F.col("term_id")).select(
        "term", F.col("embedding").alias("vector")
    )
    means = mean_word_vectors(df, materialize(vectors, "vectors"), 64)
    return rounded(means.select("doc_id", F.posexplode("vector").alias("pos", "value")), "value")


def _sound(vector: str) -> Column:
    """All numbers are finite and not all are zero."""
    finite = F.forall(vector, lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(1e30)))
    return finite & F.exists(vector, lambda v: v != 0)


def word2vec_vectors(spark, sf_dir):
    vectors = train_word_vectors(training(split_documents(spark, sf_dir)))
    return vectors.select("term", F.col("ctf").alias("n"), F.size("vector").alias("dim"), _sound("vector").alias("sound"))


def doc2vec_train(spark, sf_dir):
    model = DocumentVectorFeatures().fit(training(split_documents(spark, sf_dir)))
    return model.documents.select("doc_id", F.size("vector").alias("dim"), _sound("vector").alias("sound"))


def doc2vec_infer(spark, sf_dir):
    """Vectors of all documents, and whether a second run of inference gives the same."""
    df = split_documents(spark, sf_dir)
    model = DocumentVectorFeatures().fit(training(df))
    first, second = (model.infer(rows).withColumnRenamed("vector", name) for name, rows in (("vector", df), ("again", df.repartition(3))))
    apart = F.aggregate(F.zip_with("vector", "again", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda m, d: F.greatest(m, d.cast("double")))
    return first.join(second, "doc_id").select(
        "doc_id", F.size("vector").alias("dim"), _sound("vector").alias("sound"), (apart < 1e-4).alias("repeats"))


# --- classifiers ----------------------------------------------------------


def _stored(spark, sf_dir, extractor=None):
    df = split_documents(spark, sf_dir)
    model = (extractor or features.bow()).fit(training(df))
    return features.as_vectors(model.transform(df).select("doc_id", "label", "label_enc", "split", "features"))


def _embedding_vectors(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").alias("label_enc"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )
    return materialize(stratified_split(df, "label_enc"), "embedding-split")


def _bayes(df):
    return fit_naive_bayes(training(df)).transform(df).select(
        "doc_id", "split", F.col("label_enc").alias("truth"), F.col("prediction").cast("int"),
        vector_to_array("rawPrediction").alias("scores"), vector_to_array("probability").alias("probability"),
    )


def nb_complement(spark, sf_dir):
    scored = _bayes(_stored(spark, sf_dir))
    return rounded(scored.select("doc_id", "split", "truth", "prediction", F.array_max("scores").alias("log_probability")), "log_probability")


def nb_proba(spark, sf_dir):
    scored = _bayes(_stored(spark, sf_dir))
    return rounded(scored.select("doc_id", F.posexplode("probability").alias("class", "probability")), "probability")


def nb_dense_shift(spark, sf_dir):
    scored = _bayes(_embedding_vectors(spark, sf_dir))
    return rounded(
        scored.select(F.col("doc_id").alias("vec_id"), "split", "truth", "prediction", F.array_max("scores").alias("log_probability")),
        "log_probability",
    )


def _near(spark, sf_dir):
    df = stratified_split(table(spark, sf_dir, "embeddings"), "label", "vec_id")
    rows = materialize(df.select(F.col("vec_id").alias("id"), "label", "split", *neighbours.dense_parts(F.col("embedding"))), "vectors")
    return neighbours.nearest_neighbours(rows.where("split = 'test'"), training(rows))


def knn_predict(spark, sf_dir):
    return neighbours.vote(_near(spark, sf_dir)).withColumnRenamed("id", "vec_id")


def knn_proba(spark, sf_dir):
    return neighbours.vote_shares(_near(spark, sf_dir)).withColumnRenamed("id", "vec_id")


def _checked(scored: DataFrame) -> DataFrame:
    """Test rows with what must hold for any sound model; ``learns`` is judged over all of them.

    A model learns if its macro-F1 is more than twice that of always answering the commonest class.
    """
    scored = materialize(scored.select(
        "doc_id", F.col("label_enc").alias("truth"), F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability").alias("probability"),
    ), "scored")
    sizes = [r["count"] for r in scored.groupBy("truth").count().collect()]
    common = max(sizes, default=0) / max(sum(sizes), 1)
    f1 = evaluate(scored, (), "truth", "prediction").first()["f1_macro"]
    total = F.aggregate("probability", F.lit(0.0), lambda t, p: t + p)
    return scored.select(
        "doc_id", "truth", (F.abs(total - 1) < 1e-6).alias("probability_sums"),
        (F.array_position("probability", F.array_max("probability")) - 1 == F.col("prediction")).alias("prediction_is_best"),
        F.lit(bool(sizes and f1 > 2 * (2 * common / (1 + common)) / len(sizes))).alias("learns"),
    )


def _model_query(fit: Callable, extractor=None, embeddings: bool = False):
    def query(spark, sf_dir):
        df = _embedding_vectors(spark, sf_dir) if embeddings else _stored(spark, sf_dir, extractor)
        parts = {name: df.where(F.col("split") == name) for name in ("train", "val", "test")}
        return _checked(fit(parts["train"], parts["val"]).transform(parts["test"]))

    return query


def gbt_early_stop(spark, sf_dir):
    """Up to 500 rounds; each row also says that fitting ended before, and not at the best round."""
    df = _stored(spark, sf_dir)
    parts = {name: df.where(F.col("split") == name) for name in ("train", "val", "test")}
    model = classifiers.fit_boosted_trees_early_stop(parts["train"], parts["val"])
    ended = len(model.trees) < model.rounds_fitted
    return _checked(model.transform(parts["test"])).withColumn("best_is_not_last", F.lit(ended))


def evaluation(spark, sf_dir):
    return rounded(evaluate(_bayes(_stored(spark, sf_dir)), ["split"]), "accuracy", "f1_macro", "f1_weighted")


def report(spark, sf_dir):
    df = split_documents(spark, sf_dir)
    scored = _bayes(_stored(spark, sf_dir))
    names = df.select(F.col("label_enc").alias("class"), F.col("label").alias("name")).distinct()
    return rounded(classification_report(scored, names), "precision", "recall", "f1")


# --- zero-shot ------------------------------------------------------------


def load_stop_word_model():
    """Stands in for a language model: answers by a common word of each language."""
    answers = (("the", " EN "), ("und", "it is de"), ("el", "Es"), ("le", "fr."))

    def reply(text: str) -> str:
        document = text.split("Document:\n", 1)[1].split("\n\nRules:", 1)[0]
        words = set(document.split(" "))
        return next((answer for word, answer in answers if word in words), "unknown")

    return lambda prompts: [reply(p) for p in prompts]


def zero_shot_prompt(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", prompt(F.col("text_clean"), LANGUAGES, settings.PROMPT_TOKENS).alias("prompt"))


def zero_shot_parse(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(c) for c in REPLY_CLASSES]), (F.col("turn") % 5 + 1).cast("int"))
    form = F.col("conv_id") % 5
    raw = (
        F.when(form == 0, F.concat(F.lit(" \n"), F.upper(name), F.lit(" ")))
        .when(form == 1, F.concat(F.lit("about "), name, F.lit(" and sport")))
        .when(form == 2, F.concat(F.substring(name, 1, 4), F.lit("-x "), F.col("role")))
        .when(form == 3, F.lit(""))
        .otherwise(F.col("text"))
    )
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", read_reply(raw, REPLY_CLASSES).alias("r"))
    return df.select("conv_id", "turn", "r.class_name", "r.class_index", "r.status")


def zero_shot_batch(spark, sf_dir):
    answered = classify(corpus(spark, sf_dir), LANGUAGES, load_stop_word_model)
    return answered.select("doc_id", "reply", "class_name", "prediction", "status")


def zero_shot_eval(spark, sf_dir):
    scores = evaluate_sample(split_documents(spark, sf_dir), LANGUAGES, load_stop_word_model)
    return rounded(scores, "accuracy", "f1_macro", "f1_weighted")


def onehot_proba(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("prediction"))
    return hard_probability(df, 10).select("vec_id", F.posexplode("probability").alias("class", "probability"))


# --- grid and comparison --------------------------------------------------


def cells(spark, sf_dir):
    return grid_cells(table(spark, sf_dir, "documents"), "lang", "source")


def stages(spark, sf_dir):
    return rounded(compare.stage_times(lineitem_runs(spark, sf_dir)), "seconds")


SCORES = [f"{part}_{name}" for part in ("val", "test") for name in ("accuracy", "f1_macro", "f1_weighted")]
TIMES = ["train_time", "inference_val_time", "inference_test_time"]


def _checked_runs(rows: DataFrame, times: list[str]) -> DataFrame:
    """Cells of a grid: no error, scores within 0 and 1 and better than a guess, times filled."""
    scored = F.lit(True)
    for name in SCORES:
        scored = scored & F.coalesce(F.col(name).between(0, 1), F.lit(False))
    timed = F.lit(True)
    for name in times:
        timed = timed & F.coalesce(F.col(name) >= 0, F.lit(False))
    return rows.select(
        "feature", "model", F.col("error").isNull().alias("ran"), scored.alias("scored"),
        F.coalesce(F.col("test_f1_macro") > 0.4, F.lit(False)).alias("learns"), timed.alias("timed"),
    )


def cell_run(spark, sf_dir):
    stored = _stored(spark, sf_dir, features.tfidf())
    row = {"feature": "tfidf", "model": "logistic_regression"}
    row |= run_cell(stored, lambda train, val: classifiers.fit_logistic_regression(train))
    return _checked_runs(spark.createDataFrame([tuple(row.get(f.name) for f in RUN_SCHEMA.fields)], RUN_SCHEMA), TIMES)


def grid_run(spark, sf_dir):
    """Two extractors with two models, fresh features, two cells at a time."""
    rows = run_grid(
        split_documents(spark, sf_dir), ["bow", "tfidf"], ["logistic_regression", "naive_bayes"], parallel_cells=2, use_cache=False,
    )
    return _checked_runs(rows, [*TIMES, "feature_fit_transform_time", "feature_transform_val_time", "feature_transform_test_time"])


def pivot(spark, sf_dir):
    df = compare.pivot_mean(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag", "l_quantity", ["A", "N", "R"])
    return rounded(df, "A", "N", "R")


def speedup(spark, sf_dir):
    return compare.speedup_table(lineitem_totals(spark, sf_dir), "pipeline", "total_time", "N")


def scaling(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("x")).agg(F.sum("l_quantity").alias("total_time"))
    return rounded(compare.strong_scaling(points), "speedup", "ideal", "efficiency")


def walltime(spark, sf_dir):
    totals = lineitem_totals(spark, sf_dir).select(
        "pipeline", F.when(F.col("pipeline") != "R", F.col("total_time")).alias("total_time"),
        F.when(F.col("pipeline") == "R", F.col("total_time")).alias("total_wall_time"),
    )
    return rounded(compare.walltime_table(totals, "pipeline", ["total_time", "total_wall_time"]), "minutes")


def best(spark, sf_dir):
    return compare.best_per_group(table(spark, sf_dir, "documents"), "source", "n_chars", ["doc_id"], ["doc_id", "lang", "n_chars"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_corpus": scan_corpus,
    "sniff_separator": sniff_separator,
    "detect_header": detect_header,
    "scan_bad_rows": scan_bad_rows,
    "scan_headerless": scan_headerless,
    "infer_columns": infer_column_roles,
    "scan_runs": scan_runs,
    "runs_csv": runs_csv,
    "runs_typed": runs_typed,
    "runs_tagged": runs_tagged,
    "runs_export": runs_export,
    "runs_union": runs_union,
    "scan_scaling": scan_scaling,
    "prepare_corpus": prepare,
    "clean_text": cleaned_text,
    "clean_html": cleaned_html,
    "label_encode": label_encode,
    "class_names": class_names,
    "corpus_profile": profile,
    "stratified_split": split,
    "stratified_folds": folds,
    "sample_n": sample_n,
    "tokens_default": _token_query("default"),
    "tokens_strict": _token_query("strict"),
    "tokens_ws": _token_query("space"),
    "word_ngrams": ngram_counts,
    "term_stats": term_statistics,
    "vocab_topk": vocabulary,
    "bow_transform": bow_transform,
    "bow_features": _feature_query(features.bow()),
    "tfidf_features": _feature_query(features.tfidf()),
    "ngram_features": _feature_query(features.ngram()),
    "bow_strict": _feature_query(features.bow("strict")),
    "tfidf_strict": _feature_query(features.tfidf("strict")),
    "ngram_strict": _feature_query(features.ngram("strict")),
    "feature_cache": feature_cache,
    "feature_fingerprint": feature_fingerprint,
    "w2v_doc_mean": w2v_doc_mean,
    "word2vec_vectors": word2vec_vectors,
    "doc2vec_train": doc2vec_train,
    "doc2vec_infer": doc2vec_infer,
    "nb_complement": nb_complement,
    "nb_proba": nb_proba,
    "nb_dense_shift": nb_dense_shift,
    "knn_predict": knn_predict,
    "knn_proba": knn_proba,
    "logreg": _model_query(lambda train, val: classifiers.fit_logistic_regression(train), features.tfidf()),
    "random_forest": _model_query(lambda train, val: classifiers.fit_random_forest(train)),
    "gbt_softmax": _model_query(lambda train, val: classifiers.fit_boosted_trees(train)),
    "gbt_ovr": _model_query(lambda train, val: classifiers.fit_boosted_trees(train, joint=False)),
    "gbt_early_stop": gbt_early_stop,
    "linear_svm": _model_query(lambda train, val: classifiers.fit_linear_svm(train), features.tfidf()),
    "svm_calibrated": _model_query(lambda train, val: classifiers.fit_calibrated_svm(train), features.tfidf("strict")),
    "mlp": _model_query(lambda train, val: classifiers.fit_mlp(train), embeddings=True),
    "evaluate": evaluation,
    "classification_report": report,
    "zero_shot_prompt": zero_shot_prompt,
    "zero_shot_parse": zero_shot_parse,
    "zero_shot_batch": zero_shot_batch,
    "zero_shot_eval": zero_shot_eval,
    "onehot_proba": onehot_proba,
    "grid_cells": cells,
    "stage_times": stages,
    "cell_run": cell_run,
    "grid_run": grid_run,
    "pivot_mean": pivot,
    "speedup_table": speedup,
    "strong_scaling": scaling,
    "walltime_table": walltime,
    "best_per_group": best,
}
