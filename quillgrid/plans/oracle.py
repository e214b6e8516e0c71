"""The registered queries as SQL for DuckDB, on the same tables."""

from __future__ import annotations

from quillgrid import settings
from quillgrid.plans.queries import LANGUAGES, REPLY_CLASSES

# Fixed values, written out here again so that the SQL does not share them with the code it checks.
SPACE_CHARS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACES = f"[{SPACE_CHARS}]+"
NON_SPACE = f"[^{SPACE_CHARS}]"
TOKEN_PATTERNS = {"default": r"[a-z0-9]{2,}", "strict": r"\b[a-z][a-z0-9]{2,}\b"}
PROMPT_HEAD = "Classify the following document into exactly one of these categories: "
PROMPT_DOCUMENT = ".\n\nDocument:\n"
PROMPT_RULES = (
    "\n\nRules:\n- Reply with ONLY the category name.\n"
    "- Do not add any explanation, punctuation, or extra words.\nCategory:"
)
PREFIX_LENGTH = 4
DIGEST_DIGITS = 15


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Cleaning in four steps: markup, addresses, dropped characters, white space.
CLEANING_STEPS = (r"<[^>]+>", f"http{NON_SPACE}+|www{NON_SPACE}+", f"[^a-z0-9.,!?'{SPACE_CHARS}]", SPACES)


def cleaned(column: str) -> str:
    sql = f"lower({column})"
    for pattern in CLEANING_STEPS:
        sql = f"regexp_replace({sql}, {quoted(pattern)}, ' ', 'g')"
    return f"trim({sql}, ' ')"


def with_tables(steps: list[tuple[str, str]], final: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in steps) + "\n" + final


MISSING = ", ".join(quoted(t) for t in settings.MISSING_TOKENS)

CORPUS = [(
    "corpus",
    f"SELECT doc_id, lang AS label, {cleaned('text')} AS text_clean FROM documents "
    f"WHERE lang IS NOT NULL AND text IS NOT NULL AND regexp_matches(text, {quoted(NON_SPACE)})",
)]


def tokens(kind: str, column: str = "text_clean") -> str:
    if kind == "space":
        return f"list_filter(regexp_split_to_array({column}, {quoted(SPACES)}), lambda t: t <> '')"
    return f"regexp_extract_all({column}, {quoted(TOKEN_PATTERNS[kind])})"


def grams(low: int, high: int) -> str:
    joined = {
        1: "w",
        2: "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])",
        3: "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])",
    }
    parts = [joined[n] for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else f"list_concat({', '.join(parts)})"


def apportion(size: str, total: str, keep: str, out: str) -> str:
    """Largest remainder, ties by class."""
    return (
        f"({size} * {keep}) // {total} + (CASE WHEN row_number() OVER (ORDER BY ({size} * {keep}) % {total} DESC, class) "
        f"<= {keep} - (sum(({size} * {keep}) // {total}) OVER ()) THEN 1 ELSE 0 END) AS {out}"
    )


def ranked(source: str, label: str, key: str) -> list[tuple[str, str]]:
    seed = settings.SEED
    return [
        ("class_sizes", f"SELECT {label} AS class, count(*)::BIGINT AS n FROM {source} GROUP BY 1"),
        (
            "in_class",
            f"SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}-' || {key}), {key}) AS place FROM {source}",
        ),
    ]


def split(source: str, label: str, key: str) -> list[tuple[str, str]]:
    """A table ``divided``: the rows of ``source`` with their split."""
    part = settings.VAL_SIZE / (1.0 - settings.TEST_SIZE)
    return ranked(source, label, key) + [
        ("sizes_1", "SELECT *, (sum(n) OVER ())::BIGINT AS n_all FROM class_sizes"),
        ("sizes_2", f"SELECT *, n_all - ceil(n_all * {settings.TEST_SIZE}::DOUBLE)::BIGINT AS n_rest FROM sizes_1"),
        ("sizes_3", f"SELECT *, n_rest - ceil(n_rest * {part}::DOUBLE)::BIGINT AS n_train FROM sizes_2"),
        ("rests", f"SELECT *, {apportion('n', 'n_all', 'n_rest', 'rest')} FROM sizes_3"),
        ("trains", f"SELECT *, {apportion('rest', 'n_rest', 'n_train', 'train')} FROM rests"),
        (
            "divided",
            "SELECT r.*, CASE WHEN place <= n - rest THEN 'test' WHEN place <= n - train THEN 'val' ELSE 'train' END AS split "
            f"FROM in_class r JOIN trains t ON r.{label} = t.class",
        ),
    ]


DIVIDED = CORPUS + split("corpus", "label", "doc_id")
CODES = [("codes", "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS code FROM (SELECT DISTINCT label FROM divided)")]


def term_table(kind: str, low: int, high: int, source: str = "divided") -> list[tuple[str, str]]:
    words = f"SELECT *, {tokens(kind)} AS w FROM {source}"
    return [("terms", f"SELECT doc_id, split, unnest({grams(low, high)}) AS term FROM ({words})")]


def vocabulary(limit: int, where: str = "split = 'train'") -> list[tuple[str, str]]:
    return [(
        "vocabulary",
        "SELECT *, row_number() OVER (ORDER BY ctf DESC, term) - 1 AS term_id FROM ("
        f"SELECT term, count(*) AS ctf, count(DISTINCT doc_id) AS df FROM terms WHERE {where} GROUP BY term "
        f"ORDER BY ctf DESC, term LIMIT {limit})",
    )]


COUNTS = [("counts", "SELECT doc_id, split, term, term_id, df, count(*) AS tf FROM terms JOIN vocabulary USING (term) GROUP BY ALL")]


def feature_sql(kind: str, low: int, high: int, weighted: bool, limit: int) -> str:
    steps = DIVIDED + term_table(kind, low, high) + vocabulary(limit) + COUNTS
    if not weighted:
        return with_tables(steps, "SELECT doc_id, term, tf::DOUBLE AS value FROM counts")
    steps = steps + [(
        "weights",
        "SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM divided WHERE split = 'train'))::DOUBLE / (1 + df)) + 1) AS x "
        "FROM counts",
    )]
    return with_tables(steps, "SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS value FROM weights")


def bayes(cells: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """From ``cells(id, split, class, item, x)`` to ``scores(id, split, truth, class, score)``."""
    alpha = settings.NB_ALPHA
    return cells + [
        ("by_class", "SELECT class, item, sum(x) AS x FROM cells WHERE split = 'train' GROUP BY ALL"),
        ("by_item", "SELECT item, sum(x) AS x FROM by_class GROUP BY ALL"),
        ("classes", "SELECT DISTINCT class FROM cells WHERE split = 'train'"),
        (
            "rest",
            f"SELECT c.class, i.item, i.x - coalesce(b.x, 0) + {alpha}::DOUBLE AS x FROM classes c CROSS JOIN by_item i "
            "LEFT JOIN by_class b ON b.class = c.class AND b.item = i.item",
        ),
        ("weights", "SELECT class, item, -ln(x / sum(x) OVER (PARTITION BY class)) AS w FROM rest"),
        (
            "scores",
            "SELECT cells.id, cells.split, cells.class AS truth, w.class, sum(cells.x * w.w) AS score "
            "FROM cells JOIN weights w USING (item) GROUP BY ALL",
        ),
        (
            "best",
            "SELECT id, split, truth, class AS prediction, score - top - ln(total) AS log_probability FROM ("
            "SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, class) AS place, "
            "sum(exp(score - top)) OVER (PARTITION BY id) AS total FROM ("
            "SELECT *, max(score) OVER (PARTITION BY id) AS top FROM scores)) WHERE place = 1",
        ),
    ]


TEXT_BAYES = bayes(
    DIVIDED + CODES + term_table("default", 1, 1) + vocabulary(settings.MAX_FEATURES_BOW) + COUNTS + [(
        "cells",
        "SELECT c.doc_id AS id, c.split, k.code AS class, c.term_id AS item, c.tf::DOUBLE AS x "
        "FROM counts c JOIN divided d USING (doc_id) JOIN codes k ON k.label = d.label",
    )]
)
# What holds for every row of a sound model.
SOUND_MODEL = "TRUE AS probability_sums, TRUE AS prediction_is_best, TRUE AS learns"


def model_rows(key: str, tables: list[tuple[str, str]]) -> str:
    return with_tables(tables, f"SELECT {key}, code AS truth, {SOUND_MODEL} FROM divided JOIN codes USING (label) WHERE split = 'test'")


VECTORS = [("vectors", "SELECT vec_id, label, embedding FROM embeddings")] + split("vectors", "label", "vec_id")
DENSE_BAYES = bayes(VECTORS + [
    ("long", "SELECT vec_id AS id, split, label AS class, generate_subscripts(embedding, 1) AS item, unnest(embedding)::DOUBLE AS v FROM divided"),
    ("least", "SELECT least(min(v), 0) AS m FROM long WHERE split = 'train'"),
    ("cells", "SELECT id, split, class, item, greatest(v - m, 0) AS x FROM long, least"),
])
NEAREST = VECTORS + [
    ("unit", "SELECT vec_id, label, split, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM divided"),
    (
        "near",
        "SELECT * FROM (SELECT q.vec_id, t.vec_id AS train_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY "
        "round(1 - list_dot_product(q.e, t.e) / (q.norm * t.norm), 9), t.vec_id) AS place "
        f"FROM unit q, unit t WHERE q.split = 'test' AND t.split = 'train') WHERE place <= {settings.KNN_K}",
    ),
    ("votes", "SELECT vec_id, label, count(*) AS votes FROM near GROUP BY ALL"),
]


def class_scores(source: str, by: str = "") -> list[tuple[str, str]]:
    """``per_class`` from ``source(…, truth, prediction)``."""
    keys = f"{by}, " if by else ""
    return [
        (
            "sides",
            f"SELECT {keys}truth AS class, 1 AS actual, 0 AS predicted, (truth IS NOT DISTINCT FROM prediction)::INT AS hit FROM {source} "
            f"UNION ALL SELECT {keys}prediction, 0, 1, 0 FROM {source} WHERE prediction IS NOT NULL",
        ),
        (
            "per_class",
            f"SELECT {keys}class, sum(actual) AS support, coalesce(sum(hit) / nullif(sum(predicted), 0), 0) AS precision, "
            "coalesce(sum(hit) / nullif(sum(actual), 0), 0) AS recall, "
            f"coalesce(2 * sum(hit) / nullif(sum(actual) + sum(predicted), 0), 0) AS f1, sum(hit) AS hits FROM sides GROUP BY {keys}class",
        ),
    ]


SCORE_COLUMNS = (
    "round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted"
)

# Runs that are aggregates of lineitem.
FAILED = "max(l_linenumber) = 7 AND max(l_linestatus) = 'O'"
RUNS = [(
    "runs",
    "SELECT l_returnflag AS pipeline, l_linestatus AS feature, 'm' || l_linenumber AS model, "
    "max(l_quantity) AS feature_fit_transform_time, sum(l_quantity) / 1000 AS train_time, "
    f"CASE WHEN NOT ({FAILED}) THEN avg((l_discount > 0.05)::INT) END AS test_accuracy, "
    f"CASE WHEN NOT ({FAILED}) THEN avg((l_tax > 0.04)::INT) END AS test_f1_macro, "
    f"CASE WHEN {FAILED} THEN 'failed' END AS error FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber",
)]
STORED_RUNS = RUNS + [(
    "stored",
    "SELECT pipeline, feature, model, round(feature_fit_transform_time, 6) AS feature_fit_transform_time, "
    "round(train_time, 6) AS train_time, round(test_accuracy, 6) AS test_accuracy, round(test_f1_macro, 6) AS test_f1_macro, error FROM runs",
)]
TOTALS = [("totals", "SELECT l_returnflag AS pipeline, sum(l_quantity) AS total_time FROM lineitem GROUP BY 1")]

FIRST_WORDS = f"array_to_string(({tokens('space')})[1:{settings.PROMPT_TOKENS}], ' ')"


def reply_case(reply: str, classes: tuple[str, ...], column: str) -> str:
    """The class name, index or status that a reply stands for."""
    text = f"lower(regexp_replace({reply}, {quoted(f'^{SPACES}|{SPACES}$')}, '', 'g'))"
    first = f"({tokens('space', text)})[1]"
    rules = [("exact", lambda c: f"{text} = {quoted(c)}"), ("contains", lambda c: f"contains({text}, {quoted(c)})"),
             ("prefix", lambda c: f"starts_with({first}, {quoted(c[:PREFIX_LENGTH])})")]
    whens = []
    for status, test in rules:
        for index, name in enumerate(classes):
            answer = {"name": quoted(name), "index": str(index), "status": quoted(status)}[column]
            whens.append(f"WHEN {test(name)} THEN {answer}")
    other = {"name": "NULL", "index": "NULL", "status": f"CASE WHEN {reply} IS NULL THEN 'error' ELSE 'default' END"}[column]
    return f"CASE {' '.join(whens)} ELSE {other} END"


def reply_columns(reply: str, classes: tuple[str, ...], index_name: str) -> str:
    return (
        f"{reply_case(reply, classes, 'name')} AS class_name, {reply_case(reply, classes, 'index')}::INT AS {index_name}, "
        f"{reply_case(reply, classes, 'status')} AS status"
    )


WORD_REPLY = (
    f"CASE WHEN list_contains({tokens('space')}, 'the') THEN ' EN ' WHEN list_contains({tokens('space')}, 'und') THEN 'it is de' "
    f"WHEN list_contains({tokens('space')}, 'el') THEN 'Es' WHEN list_contains({tokens('space')}, 'le') THEN 'fr.' ELSE 'unknown' END"
)
SYNTHETIC_REPLY = (
    "CASE conv_id % 5 WHEN 0 THEN chr(32) || chr(10) || upper(name) || ' ' WHEN 1 THEN 'about ' || name || ' and sport' "
    "WHEN 2 THEN name[1:4] || '-x ' || role WHEN 3 THEN '' ELSE text END"
)


def sampled(source: str, size: int) -> str:
    return f"SELECT * FROM {source} ORDER BY md5('{settings.SEED}-' || doc_id), doc_id LIMIT {size}"


ORDER_LINE = "concat(o_orderkey, mark, o_orderstatus, mark, o_orderpriority)"
NAME_KEYS = " ".join(f"WHEN '{code}' THEN {quoted(name)}" for code, name in settings.CLASS_NAMES.items())


def mean_vectors() -> str:
    steps = CORPUS + [
        ("terms", f"SELECT doc_id, unnest({tokens('space')}) AS term FROM corpus"),
        *vocabulary(settings.MAX_FEATURES_BOW, "true"),
        ("known", "SELECT v.term, e.embedding::DOUBLE[] AS e FROM vocabulary v JOIN embeddings e ON e.vec_id = v.term_id"),
        ("long", "SELECT doc_id, generate_subscripts(e, 1) - 1 AS pos, unnest(e) AS x FROM terms JOIN known USING (term)"),
        ("means", "SELECT doc_id, pos, avg(x) AS value FROM long GROUP BY ALL"),
    ]
    return with_tables(
        steps,
        "SELECT c.doc_id, p.pos::INT AS pos, round(coalesce(m.value, 0), 6) AS value FROM corpus c CROSS JOIN (SELECT unnest(range(64)) AS pos) p "
        "LEFT JOIN means m ON m.doc_id = c.doc_id AND m.pos = p.pos",
    )


def profile_sql() -> str:
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", avg(length({c}::VARCHAR)) AS mean_length, "
        f"coalesce(bool_or({c} IS NOT NULL AND try_cast({c}::VARCHAR AS DOUBLE) IS NULL), false) AS is_text FROM documents"
        for c in columns
    )
    shortest = "(SELECT \"column\" FROM profile WHERE is_text ORDER BY mean_length LIMIT 1)"
    return with_tables(
        [("profile", rows)],
        "SELECT \"column\", round(mean_length, 6) AS mean_length, is_text, CASE WHEN \"column\" = 'text' THEN 'text' "
        f"WHEN \"column\" = {shortest} THEN 'label' ELSE 'none' END AS role FROM profile",
    )


def token_sql(kind: str) -> str:
    return with_tables(
        CORPUS + [("lists", f"SELECT doc_id, {tokens(kind)} AS w FROM corpus")],
        "SELECT doc_id, (generate_subscripts(w, 1) - 1)::INT AS pos, unnest(w) AS token FROM lists",
    )


def run_line(columns: tuple[str, ...]) -> str:
    numbers = ("feature_fit_transform_time", "train_time", "test_accuracy", "test_f1_macro")
    cells = [f"coalesce(printf('%.6f', {c}), '')" if c in numbers else f"coalesce({c}, '')" for c in columns]
    return " || chr(9) || ".join(cells)


RUN_COLUMNS = ("feature", "model", "feature_fit_transform_time", "train_time", "test_accuracy", "test_f1_macro", "error")
MAX_BOW, MAX_TFIDF = settings.MAX_FEATURES_BOW, settings.MAX_FEATURES_TFIDF
FIRST_CELL = "CASE WHEN p_size % 2 = 0 THEN p_name ELSE '\"-' || p_size || '\"' END"
DIGITS_ONLY = "regexp_full_match(replace(ltrim(trim(trim(c), '\"'), '-'), '.', ''), '[0-9]+')"

ORACLE: dict[str, str] = {
    "scan_corpus": f"SELECT doc_id, lang AS label, text FROM documents WHERE regexp_matches(text, {quoted(NON_SPACE)}) "
    f"AND text NOT IN ({MISSING}) AND lang NOT IN ({MISSING})",
    "sniff_separator": with_tables(
        [("lines", f"SELECT o_orderkey, {ORDER_LINE} AS line FROM (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN chr(9) ELSE ',' END AS mark FROM orders)")],
        "SELECT o_orderkey, CASE WHEN length(line) - length(replace(line, chr(9), '')) > length(line) - length(replace(line, ',', '')) "
        "THEN chr(9) ELSE ',' END AS separator FROM lines",
    ),
    "detect_header": with_tables(
        [("lines", f"SELECT p_partkey, string_split(trim({FIRST_CELL} || ',' || p_brand || ',' || p_type), ',')[1:3] AS cells FROM part")],
        f"SELECT p_partkey, len(list_filter(cells, lambda c: {DIGITS_ONLY} OR length(trim(c)) >= 40)) = 0 AS is_header FROM lines",
    ),
    "scan_bad_rows": "SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_custkey % 7 <> 0 AND o_custkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status, "
    "CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 11 = 0 THEN o_orderpriority ELSE o_orderpriority || '\"' || chr(10) || ',' END AS priority "
    "FROM orders WHERE o_custkey % 5 <> 0",
    "scan_headerless": "SELECT o_orderkey::VARCHAR AS col0, o_orderstatus AS col1, o_orderpriority AS col2 FROM orders",
    "infer_columns": profile_sql(),
    "scan_runs": with_tables(STORED_RUNS, "SELECT * FROM stored"),
    "runs_csv": with_tables(STORED_RUNS, "SELECT * FROM stored"),
    "runs_typed": with_tables(
        STORED_RUNS, "SELECT pipeline, feature, model, test_accuracy, test_f1_macro FROM stored WHERE test_accuracy IS NOT NULL"
    ),
    "runs_tagged": with_tables(
        RUNS + TOTALS, "SELECT pipeline, count(*) AS n_rows, round(any_value(total_time), 4) AS total_time FROM runs JOIN totals USING (pipeline) GROUP BY 1"
    ),
    "runs_export": with_tables(
        RUNS + TOTALS,
        "SELECT pipeline, 'total_time: ' || printf('%.4f', total_time) AS line FROM totals UNION ALL SELECT pipeline, '' FROM totals "
        f"UNION ALL SELECT pipeline, array_to_string({list(RUN_COLUMNS)}, chr(9)) FROM totals UNION ALL SELECT pipeline, {run_line(RUN_COLUMNS)} FROM runs",
    ),
    "runs_union": with_tables(
        RUNS,
        "SELECT pipeline, feature, model, CASE WHEN pipeline <> 'N' THEN round(train_time, 6) END AS train_time, "
        "round(test_accuracy, 6) AS test_accuracy, CASE WHEN pipeline <> 'A' THEN error END AS error FROM runs",
    ),
    "scan_scaling": "SELECT l_linenumber AS x, round(sum(l_quantity), 4) AS total_time FROM lineitem GROUP BY 1",
    "prepare_corpus": with_tables(CORPUS, "SELECT doc_id, label, length(text_clean)::INT AS n_clean_chars FROM corpus"),
    "clean_text": f"SELECT doc_id, {cleaned('text')} AS text_clean FROM documents",
    "clean_html": f"SELECT page_id, {cleaned('html')} AS text_clean FROM pages",
    "label_encode": "SELECT source AS label, doc_id, (dense_rank() OVER (ORDER BY source) - 1)::INT AS label_enc FROM documents",
    "class_names": f"SELECT vec_id, CASE label::VARCHAR {NAME_KEYS} ELSE label::VARCHAR END AS class_name FROM embeddings",
    "corpus_profile": with_tables(
        CORPUS,
        "SELECT count(*) AS n_rows, count(DISTINCT label) AS n_classes, string_agg(DISTINCT label, ',' ORDER BY label) AS classes FROM corpus",
    ),
    "stratified_split": with_tables(DIVIDED, "SELECT doc_id, split FROM divided"),
    "stratified_folds": with_tables(
        CORPUS + ranked("corpus", "label", "doc_id"),
        "SELECT doc_id, CASE WHEN place <= n // 3 THEN 0 WHEN place <= n * 2 // 3 THEN 1 ELSE 2 END::INT AS fold "
        "FROM in_class r JOIN class_sizes c ON r.label = c.class",
    ),
    "sample_n": with_tables(CORPUS, f"SELECT doc_id FROM ({sampled('corpus', 500)})"),
    "tokens_default": token_sql("default"),
    "tokens_strict": token_sql("strict"),
    "tokens_ws": token_sql("space"),
    "word_ngrams": with_tables(
        CORPUS + [("lists", f"SELECT doc_id, {tokens('default')} AS w FROM corpus"), ("all_grams", f"SELECT doc_id, unnest({grams(2, 3)}) AS ngram FROM lists")],
        "SELECT doc_id, ngram, count(*) AS n FROM all_grams GROUP BY ALL",
    ),
    "term_stats": with_tables(
        CORPUS + [("terms", f"SELECT doc_id, unnest({tokens('default')}) AS term FROM corpus")],
        "SELECT term, count(*) AS ctf, count(DISTINCT doc_id) AS df FROM terms GROUP BY term",
    ),
    "vocab_topk": with_tables(
        CORPUS + [("terms", f"SELECT doc_id, unnest({tokens('default')}) AS term FROM corpus")] + vocabulary(MAX_BOW, "true"),
        "SELECT term, term_id::INT AS term_id, ctf, df FROM vocabulary",
    ),
    "bow_transform": with_tables(
        CORPUS + [
            ("known", f"SELECT DISTINCT unnest({tokens('default', cleaned('text'))}) AS term FROM benchmark"),
            ("terms", f"SELECT doc_id, unnest({tokens('default')}) AS term FROM corpus"),
        ],
        "SELECT doc_id, term, count(*)::DOUBLE AS value FROM terms JOIN known USING (term) GROUP BY ALL",
    ),
    "bow_features": feature_sql("default", 1, 1, False, MAX_BOW),
    "tfidf_features": feature_sql("default", 1, 2, True, MAX_TFIDF),
    "ngram_features": feature_sql("default", 2, 3, True, MAX_TFIDF),
    "bow_strict": feature_sql("strict", 1, 1, False, MAX_BOW),
    "tfidf_strict": feature_sql("strict", 1, 2, True, MAX_TFIDF),
    "ngram_strict": feature_sql("strict", 2, 3, True, MAX_TFIDF),
    "feature_cache": with_tables(
        DIVIDED + term_table("default", 1, 1) + vocabulary(MAX_BOW) + COUNTS,
        "SELECT doc_id, split, term_id::INT AS term_id, tf::DOUBLE AS value FROM counts",
    ),
    "feature_fingerprint": with_tables(
        DIVIDED,
        "SELECT split, count(*) AS n_rows, sum(('0x' || md5(doc_id || chr(31) || label || chr(31) || text_clean)"
        f"[1:{DIGEST_DIGITS}])::BIGINT)::VARCHAR AS digest FROM divided GROUP BY split",
    ),
    "w2v_doc_mean": mean_vectors(),
    "nb_complement": with_tables(
        TEXT_BAYES, "SELECT id AS doc_id, split, truth, prediction, round(log_probability, 6) + 0::DOUBLE AS log_probability FROM best"
    ),
    "nb_proba": with_tables(
        TEXT_BAYES + [("top", "SELECT *, exp(score - max(score) OVER (PARTITION BY id)) AS e FROM scores")],
        "SELECT id AS doc_id, class, round(e / sum(e) OVER (PARTITION BY id), 6) AS probability FROM top",
    ),
    "nb_dense_shift": with_tables(
        DENSE_BAYES, "SELECT id AS vec_id, split, truth, prediction, round(log_probability, 6) + 0::DOUBLE AS log_probability FROM best"
    ),
    "knn_predict": with_tables(
        NEAREST,
        "SELECT vec_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, label) AS place FROM votes) WHERE place = 1",
    ),
    "knn_proba": with_tables(NEAREST, "SELECT vec_id, label, votes / sum(votes) OVER (PARTITION BY vec_id) AS share FROM votes"),
    **{name: model_rows("doc_id", DIVIDED + CODES) for name in ("logreg", "random_forest", "gbt_softmax", "gbt_ovr", "linear_svm", "svm_calibrated")},
    "gbt_early_stop": model_rows("doc_id", DIVIDED + CODES).replace(SOUND_MODEL, SOUND_MODEL + ", TRUE AS best_is_not_last"),
    "mlp": with_tables(VECTORS, f"SELECT vec_id AS doc_id, label AS truth, {SOUND_MODEL} FROM divided WHERE split = 'test'"),
    "word2vec_vectors": with_tables(
        DIVIDED + term_table("space", 1, 1),
        f"SELECT term, count(*)::BIGINT AS n, {settings.EMBEDDING_DIM} AS dim, TRUE AS sound FROM terms WHERE split = 'train' "
        f"GROUP BY term HAVING count(*) >= {settings.EMBEDDING_MIN_COUNT}",
    ),
    "doc2vec_train": with_tables(DIVIDED, f"SELECT doc_id, {settings.EMBEDDING_DIM} AS dim, TRUE AS sound FROM divided WHERE split = 'train'"),
    "doc2vec_infer": with_tables(DIVIDED, f"SELECT doc_id, {settings.EMBEDDING_DIM} AS dim, TRUE AS sound, TRUE AS repeats FROM divided"),
    "cell_run": "SELECT 'tfidf' AS feature, 'logistic_regression' AS model, TRUE AS ran, TRUE AS scored, TRUE AS learns, TRUE AS timed",
    "grid_run": "SELECT f AS feature, m AS model, TRUE AS ran, TRUE AS scored, TRUE AS learns, TRUE AS timed "
    "FROM (SELECT unnest(['bow', 'tfidf']) AS f) CROSS JOIN (SELECT unnest(['logistic_regression', 'naive_bayes']) AS m)",
    "evaluate": with_tables(TEXT_BAYES + class_scores("best", "split"), f"SELECT split, {SCORE_COLUMNS} FROM per_class GROUP BY split"),
    "classification_report": with_tables(
        TEXT_BAYES + class_scores("best") + [
            ("named", "SELECT k.label AS class, p.precision, p.recall, p.f1, p.support FROM per_class p JOIN codes k ON k.code = p.class"),
            ("total", "SELECT sum(support) AS support, sum(recall * support) / sum(support) AS accuracy FROM named"),
        ],
        "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM ("
        "SELECT * FROM named UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, support FROM total "
        "UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM named "
        "UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), "
        "sum(f1 * support) / sum(support), sum(support) FROM named)",
    ),
    "zero_shot_prompt": with_tables(
        CORPUS,
        f"SELECT doc_id, {quoted(PROMPT_HEAD + ', '.join(LANGUAGES) + PROMPT_DOCUMENT)} || {FIRST_WORDS} || {quoted(PROMPT_RULES)} AS prompt FROM corpus",
    ),
    "zero_shot_parse": with_tables(
        [
            ("names", f"SELECT *, ({list(REPLY_CLASSES)})[turn % 5 + 1] AS name FROM conversations"),
            ("replies", f"SELECT conv_id, turn, {SYNTHETIC_REPLY} AS raw FROM names"),
        ],
        f"SELECT conv_id, turn, {reply_columns('raw', REPLY_CLASSES, 'class_index')} FROM replies",
    ),
    "zero_shot_batch": with_tables(
        CORPUS + [("replies", f"SELECT doc_id, {WORD_REPLY} AS reply FROM corpus")],
        f"SELECT doc_id, reply, {reply_columns('reply', LANGUAGES, 'prediction')} FROM replies",
    ),
    "zero_shot_eval": with_tables(
        CORPUS + [
            ("chosen", sampled("corpus", settings.ZERO_SHOT_SAMPLE)),
            ("codes", "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS code FROM (SELECT DISTINCT label FROM corpus)"),
            ("replies", f"SELECT code AS truth, {WORD_REPLY} AS reply FROM chosen JOIN codes USING (label)"),
            ("answers", f"SELECT truth, {reply_case('reply', LANGUAGES, 'index')}::INT AS prediction FROM replies"),
        ] + class_scores("answers"),
        f"SELECT {SCORE_COLUMNS} FROM per_class",
    ),
    "onehot_proba": "SELECT vec_id, c AS class, (label = c)::INT::DOUBLE AS probability FROM embeddings CROSS JOIN (SELECT unnest(range(10))::INT AS c)",
    "grid_cells": "SELECT l.lang AS feature, s.source AS model FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s",
    "stage_times": with_tables(
        RUNS + [("per_feature", "SELECT feature, max(feature_fit_transform_time) AS f, sum(train_time) AS t FROM runs GROUP BY 1")],
        "SELECT 'model_training_' || feature AS stage, round(t, 6) AS seconds FROM per_feature UNION ALL "
        "SELECT 'feature_extraction_total', round(sum(f), 6) FROM per_feature UNION ALL SELECT 'model_training_total', round(sum(t), 6) FROM per_feature",
    ),
    "pivot_mean": "SELECT l_linenumber, " + ", ".join(
        f"round(avg(l_quantity) FILTER (l_returnflag = '{v}'), 6) AS {v}" for v in ("A", "N", "R")
    ) + " FROM lineitem GROUP BY 1",
    "speedup_table": with_tables(
        TOTALS,
        "SELECT pipeline, total_time AS total_time_s, round(total_time / 60, 2) AS total_time_min, "
        "round((SELECT total_time FROM totals WHERE pipeline = 'N') / total_time, 2) AS speedup_vs_serial FROM totals",
    ),
    "strong_scaling": with_tables(
        [("points", "SELECT l_linenumber AS x, sum(l_quantity) AS total_time FROM lineitem GROUP BY 1"),
         ("base", "SELECT arg_min(total_time, x) AS t, min(x) AS x FROM points")],
        "SELECT p.x, p.total_time, round(b.t / p.total_time, 6) AS speedup, round(p.x / b.x, 6) AS ideal, "
        "round((b.t / p.total_time) / (p.x / b.x), 6) AS efficiency FROM points p, base b",
    ),
    "walltime_table": with_tables(TOTALS, "SELECT pipeline, round(total_time / 60, 6) AS minutes FROM totals"),
    "best_per_group": "SELECT source, doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place "
    "FROM documents) WHERE place = 1",
}
