"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS]. Each
query is planned and run to the end into the ``noop`` sink, so no rows reach
the driver. Names on the command line run those queries instead.
"""

from __future__ import annotations

import json
import os
import sys
import time

from quillgrid.plans.queries import QUERIES, split_documents
from quillgrid.session import local_session

HEADLINE = (
    "clean_text", "stratified_split", "sample_n", "term_stats", "word_ngrams", "bow_features", "tfidf_features",
    "ngram_features", "tfidf_strict", "w2v_doc_mean", "nb_complement", "evaluate", "knn_predict", "zero_shot_batch",
    "scan_corpus", "best_per_group", "strong_scaling", "pivot_mean", "logreg", "random_forest", "linear_svm",
    "word2vec_vectors", "doc2vec_train", "svm_calibrated", "mlp", "cell_run",
    "gbt_softmax",
)


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = local_session("quillgrid-bench", cores=cpus, partitions=cpus)
    spark.sparkContext.setLogLevel("OFF")
    start = time.perf_counter()
    documents = split_documents(spark, sf_dir).count()
    seconds = {"prepare_and_split": round(time.perf_counter() - start, 3)}
    for name in names or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "documents_per_second": {name: round(documents / max(s, 1e-3), 1) for name, s in seconds.items()}, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
