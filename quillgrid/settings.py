"""Default settings of an experiment."""

from __future__ import annotations

# Results depend on them, so they are stated plainly.
SEED = 42
TEST_SIZE = 0.20
VAL_SIZE = 0.10

MAX_FEATURES_BOW = 20_000
MAX_FEATURES_TFIDF = 20_000
NGRAM_RANGE_BOW = (1, 1)
NGRAM_RANGE_TFIDF = (1, 2)
NGRAM_RANGE_NGRAM = (2, 3)

EMBEDDING_DIM = 100
EMBEDDING_WINDOW = 5
EMBEDDING_MIN_COUNT = 2
EMBEDDING_EPOCHS = 10

LOGREG_C = 1.0
LOGREG_MAX_ITER = 1000
LOGREG_TOLERANCE = 1e-4
FOREST_TREES = 200
FOREST_MAX_DEPTH = 30
BOOST_ROUNDS = 200
BOOST_ROUNDS_EARLY_STOP = 500
BOOST_PATIENCE = 20
BOOST_DEPTH = 6
BOOST_ETA = 0.1
SVM_C = 1.0
SVM_MAX_ITER = 2000
SVM_TOLERANCE = 1e-3
SVM_CALIBRATION_FOLDS = 3
SVM_SIGMOID_FOLDS = 5
NB_ALPHA = 1.0
KNN_K = 5
MLP_HIDDEN = (256, 128)
MLP_MAX_ITER = 300

ZERO_SHOT_SAMPLE = 500
ZERO_SHOT_BATCH = 4
PROMPT_TOKENS = 256

# Names of class codes, and the column names that are known by themselves.
CLASS_NAMES = {0: "politics", 1: "sport", 2: "tech", 3: "entertainment", 4: "business"}

TEXT_COLUMN_NAMES = (
    "text", "document", "content", "body", "article",
    "review", "sentence", "description", "abstract", "paragraph",
)
LABEL_COLUMN_NAMES = (
    "label", "category", "class", "target", "tag",
    "type", "genre", "topic", "subject",
)

# Cells that a delimited file uses for a missing value.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Size limits of our own: a side is broadcast only below them.
BROADCAST_ROWS = 50_000
BROADCAST_LIMIT = 128 * 1024 * 1024
BROADCAST_BYTES = 256 * 1024 * 1024
