"""Features stored once per corpus and extractor."""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from quillgrid.operators.features import read_features, vector_schema
from quillgrid.session import scratch_path, shared_dir

# Fixed value: hex digits of a row hash that are added up.
DIGEST_DIGITS = 15


def fingerprint(df: DataFrame, columns: tuple[str, ...] = ("doc_id", "label", "text_clean"), by: str = "split") -> DataFrame:
    """``(by, n_rows, digest)``: a sum of row hashes, the same for any order and partitioning.

    A sum, unlike an exclusive or, also sees rows that come in equal pairs.
    """
    row = F.md5(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns]))
    number = F.conv(F.substring(row, 1, DIGEST_DIGITS), 16, 10).cast("decimal(20,0)")
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), F.sum(number).cast("string").alias("digest"))


@dataclass(frozen=True)
class FeatureCache:
    """Feature tables in the shared folder, keyed by content and extractor settings."""

    root: str

    @staticmethod
    def shared(df: DataFrame) -> "FeatureCache":
        return FeatureCache(f"{shared_dir(df.sparkSession).rstrip('/')}/quillgrid/features")

    def digest(self, corpus: DataFrame) -> str:
        """Of all rows: computed once for all extractors of a run."""
        return "|".join(sorted(f"{r.split}:{r.n_rows}:{r.digest}" for r in fingerprint(corpus).collect()))

    def load_or_extract(
        self, corpus: DataFrame, extractor: Any, digest: str | None = None, use_cache: bool = True,
        times: dict[str, float] | None = None,
    ) -> tuple[DataFrame, bool]:
        """``(features, hit)`` with ``doc_id, label_enc, features, split``.

        The extractor is fitted on training rows only. A marker table is written
        after the features, so a broken write is not taken for a hit. Without
        ``use_cache`` the features are made anew in a folder of their own.
        ``times`` gets the seconds of each step that ran.
        """
        spark = corpus.sparkSession
        digest = digest if digest is not None else self.digest(corpus)
        key = hashlib.md5(f"{extractor!r}|{digest}".encode()).hexdigest()[:12]
        path = f"{self.root}/{extractor.name}-{key}" if use_cache else scratch_path(spark, f"fresh-{extractor.name}")
        hit = use_cache and _exists(spark, f"{path}-done")
        if not hit:
            start = time.perf_counter()
            model = extractor.fit(corpus.where(F.col("split") == "train"))
            for part, step in (("train", "fit_transform"), ("val", "transform_val"), ("test", "transform_test")):
                wide = model.transform(corpus.where(F.col("split") == part)).select("doc_id", "label_enc", "features", "split")
                wide.write.mode("overwrite" if part == "train" else "append").partitionBy("split").parquet(path)
                now = time.perf_counter()
                if times is not None:
                    times[f"feature_{step}_time"] = now - start
                start = now
            spark.range(1).withColumnRenamed("id", "done").write.mode("overwrite").parquet(f"{path}-done")
        stored = spark.read.parquet(path)
        return read_features(spark, path, vector_schema(stored)), hit


def _exists(spark, path: str) -> bool:
    try:
        return not spark.read.schema("done long").parquet(path).isEmpty()
    except AnalysisException:
        return False
