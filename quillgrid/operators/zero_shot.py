"""Zero-shot classification as a batch job with a model supplied by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from quillgrid import settings
from quillgrid.functions.replies import class_name, one_hot, prompt, read_reply
from quillgrid.operators.evaluate import evaluate
from quillgrid.operators.split import sample_rows

# A generator takes prompts and returns one reply each.
Generator = Callable[[Sequence[str]], Iterable[str | None]]


def class_list(dictionary: DataFrame, names: dict[int, str] = settings.CLASS_NAMES) -> list[str]:
    """Class names in the order of their codes; one row per class reaches the driver."""
    named = dictionary.select("label_enc", class_name(F.col("label"), names).alias("name"))
    return [row.name for row in named.orderBy("label_enc").collect()]


def generate(load: Callable[[], Generator], batch_size: int = settings.ZERO_SHOT_BATCH) -> Callable[[Column], Column]:
    """A column function from prompts to replies.

    ``load`` runs once per Python worker, the generator once per batch. A batch
    that fails gives missing replies, which are reported as errors.
    """

    def make() -> Callable[[np.ndarray], np.ndarray]:
        generator = load()

        def predict(prompts: np.ndarray) -> np.ndarray:
            try:
                replies = list(generator(list(prompts)))
                if len(replies) != len(prompts):
                    raise ValueError("a generator returns one reply per prompt")
            except Exception:
                replies = [None] * len(prompts)
            return np.array(replies, dtype=object)

        return predict

    return predict_batch_udf(make, return_type=StringType(), batch_size=batch_size)


def classify(
    df: DataFrame,
    classes: Sequence[str],
    load: Callable[[], Generator],
    text_column: str = "text_clean",
    batch_size: int = settings.ZERO_SHOT_BATCH,
    max_tokens: int | None = None,
) -> DataFrame:
    """Add ``prompt, reply, class_name, prediction, status`` to every row; prompts hold whole texts unless ``max_tokens`` is given."""
    replied = df.withColumn("prompt", prompt(F.col(text_column), classes, max_tokens)).withColumn(
        "reply", generate(load, batch_size)(F.col("prompt"))
    )
    answer = read_reply(F.col("reply"), classes)
    return (
        replied.withColumn("_answer", answer)
        .withColumn("class_name", F.col("_answer.class_name"))
        .withColumn("prediction", F.col("_answer.class_index"))
        .withColumn("status", F.col("_answer.status"))
        .drop("_answer")
    )


def hard_probability(df: DataFrame, classes: int) -> DataFrame:
    """Add ``probability``: 1 at the predicted class."""
    return df.withColumn("probability", one_hot(F.col("prediction"), classes))


def evaluate_sample(
    df: DataFrame,
    classes: Sequence[str],
    load: Callable[[], Generator],
    id_column: str = "doc_id",
    label_column: str = "label_enc",
    size: int = settings.ZERO_SHOT_SAMPLE,
    seed: int = settings.SEED,
) -> DataFrame:
    """Scores over a sample of ``size`` rows, and over exactly those rows."""
    answered = classify(sample_rows(df, id_column, size, seed), classes, load)
    return evaluate(answered, (), label_column, "prediction")
