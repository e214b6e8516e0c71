"""The experiment grid: every extractor with every model, one run row per cell."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from quillgrid.operators.cache import FeatureCache
from quillgrid.operators.evaluate import evaluate
from quillgrid.operators.prepare import encode_labels, label_dictionary
from quillgrid.operators.split import sample_rows, stratified_split
from quillgrid.operators.zero_shot import Generator, class_list, classify
from quillgrid.plans.registry import EXTRACTORS, MODELS, Fit
from quillgrid.session import materialize
from quillgrid.sources.runs import RUN_SCHEMA

RAW_TEXT = "raw_text"


@contextmanager
def timed(step: str, times: dict[str, float]) -> Iterator[None]:
    """Wall time of the actions inside, as ``<step>_time``."""
    start = time.perf_counter()
    try:
        yield
    finally:
        times[f"{step}_time"] = time.perf_counter() - start


def split_corpus(corpus: DataFrame) -> DataFrame:
    """Encode labels and split; stored, because every cell reads it."""
    encoded = encode_labels(corpus, materialize(label_dictionary(corpus), "labels"))
    return materialize(stratified_split(encoded), "corpus")


def grid_cells(options: DataFrame, feature: str = "feature", model: str = "model") -> DataFrame:
    """``(feature, model)``: every value of one column with every value of the other.

    Both sets are names of a configuration, so each fits into one array.
    """
    sets = options.agg(F.collect_set(feature).alias("features"), F.collect_set(model).alias("models"))
    return sets.select(F.explode("features").alias("feature"), "models").select("feature", F.explode("models").alias("model"))


def run_cell(features: DataFrame, fit: Fit, train: DataFrame | None = None) -> dict[str, Any]:
    """Train on the training rows, score validation and test rows in one pass each.

    ``train`` gives training rows that the caller keeps in memory for several
    cells; without it they are kept for this cell.
    """
    row: dict[str, Any] = {}
    parts = {name: features.where(F.col("split") == name) for name in ("train", "val", "test")}
    own = train is None
    train = parts["train"].persist(StorageLevel.MEMORY_AND_DISK) if own else train
    try:
        with timed("train", row):
            model = fit(train, parts["val"])
        for name in ("val", "test"):
            with timed(f"inference_{name}", row):
                scores = evaluate(model.transform(parts[name]), (), "label_enc", "prediction").first()
            row.update({f"{name}_{metric}": scores[metric] for metric in ("accuracy", "f1_macro", "f1_weighted")})
    finally:
        if own:
            train.unpersist()
    return row


def _guarded(pipeline: str, feature: str, model: str, work: Callable[[], dict[str, Any]]) -> dict[str, Any]:
    """A failing cell becomes a row with its error, and the grid goes on."""
    row = {"pipeline": pipeline, "feature": feature, "model": model}
    try:
        row.update(work())
    except Exception as error:
        row["error"] = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
    return row


def _journal_rows(spark, journal: str | None, variant: str) -> dict[tuple[str, str], dict[str, Any]]:
    """Finished cells of a journal by feature and model; the folder need not be there yet."""
    if journal is None:
        return {}
    path = spark._jvm.org.apache.hadoop.fs.Path(journal)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    done = spark.read.schema(RUN_SCHEMA).parquet(journal).where((F.col("pipeline") == variant) & F.col("error").isNull())
    return {(r["feature"], r["model"]): r.asDict() for r in done.collect()}


def run_grid(
    corpus: DataFrame,
    features: Sequence[str] | None = None,
    models: Sequence[str] | None = None,
    variant: str = "default",
    extractors: Mapping[str, Any] | None = None,
    fits: Mapping[str, Fit] | None = None,
    generators: Mapping[str, Callable[[], Generator]] | None = None,
    parallel_cells: int = 1,
    use_cache: bool = True,
    zero_shot_sample: int | None = None,
    journal: str | None = None,
) -> DataFrame:
    """Run rows of a split corpus in the fixed run schema.

    Features are extracted once per extractor and shared by its models. Cells of
    one extractor may overlap: Spark schedules their jobs side by side, and their
    training rows are kept in memory until the last of them is done. Without
    ``use_cache`` features are made anew, so their times are those of the work.
    Zero-shot rows are scored on all test rows, or on ``zero_shot_sample`` of them.

    ``journal`` names a shared folder that each finished cell is added to. A later
    call with it takes the cells that ran without an error from there, so a grid
    whose driver is lost goes on where it stopped; one journal is for one corpus.
    """
    extractors = extractors or {name: make() for name, make in EXTRACTORS[variant].items()}
    fits = fits or MODELS[variant]
    cache = FeatureCache.shared(corpus)
    digest = cache.digest(corpus) if use_cache else ""
    rows: list[dict[str, Any]] = []
    known = _journal_rows(corpus.sparkSession, journal, variant)

    def told(row: dict[str, Any]) -> dict[str, Any]:
        if journal is not None:
            values = tuple(row.get(field.name) for field in RUN_SCHEMA.fields)
            corpus.sparkSession.createDataFrame([values], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(journal)
        return row

    with ThreadPoolExecutor(max_workers=max(1, parallel_cells)) as pool:
        for feature in features or list(extractors):
            times: dict[str, float] = {}
            failure, stored, train = None, None, None
            chosen = list(models or fits)
            rows.extend(known[feature, model] for model in chosen if (feature, model) in known)
            chosen = [model for model in chosen if (feature, model) not in known]
            if not chosen:
                continue
            try:
                with timed("feature", times):
                    stored, _ = cache.load_or_extract(corpus, extractors[feature], digest, use_cache, times)
                train = stored.where(F.col("split") == "train").persist(StorageLevel.MEMORY_AND_DISK)
            except Exception as error:
                failure = error

            def cell(model: str, stored=stored, train=train, failure=failure, times=times) -> dict[str, Any]:
                if failure is not None:
                    raise failure
                return {**times, **run_cell(stored, fits[model], train)}

            rows.extend(pool.map(
                lambda model, feature=feature, cell=cell: told(_guarded(variant, feature, model, lambda: cell(model))), chosen
            ))
            if train is not None:
                train.unpersist()
    for name, load in (generators or {}).items():
        rows.append(_guarded(variant, RAW_TEXT, name, lambda load=load: run_zero_shot(corpus, load, zero_shot_sample)))
    spark = corpus.sparkSession
    ordered = [tuple(row.get(field.name) for field in RUN_SCHEMA.fields) for row in rows]
    return spark.createDataFrame(ordered, RUN_SCHEMA)


def run_zero_shot(corpus: DataFrame, load: Callable[[], Generator], size: int | None = None) -> dict[str, Any]:
    """Scores of all test rows, or of a sample of ``size`` of them."""
    row: dict[str, Any] = {}
    with timed("train", row):
        classes = class_list(materialize(corpus.select("label", "label_enc").distinct(), "classes"))
    test = corpus.where(F.col("split") == "test")
    sample = test if size is None else sample_rows(test, "doc_id", size)
    with timed("inference_test", row):
        scores = evaluate(classify(sample, classes, load), (), "label_enc", "prediction").first()
    row.update({f"test_{metric}": scores[metric] for metric in ("accuracy", "f1_macro", "f1_weighted")})
    return row
