"""Personal data by fixed patterns and by contexts learnt from them.

Addresses, numbers and cards that the fixed patterns find are the seeds, and so
are secrets: what follows a word for one with ``=`` or ``:``, and keys of a known
form. A candidate is a run of words that hold a digit or an at sign, one space
apart, without quotes, colons and equals signs around it. Its patterns are the
word and the two words before it, the word behind it, and, where it has a letter, its
shape. Patterns and candidates form a bipartite graph with one edge for each
different pair, so copies of a text add nothing. Scores run over it for ``ROUNDS``
rounds: a pattern's score for a kind is the smoothed mean over its candidates, a
candidate's the greatest of its patterns if at least ``MIN_CANDIDATE``, a seed's is one. A candidate outside all
base spans becomes a span of a kind if one of its patterns has a score of at least
``MIN_CONTEXT``; smoothing by ``PRIOR`` asks for about eight different seeds with
such a pattern. Seeds of secrets are spans of their own kind as well.

All steps are built-in expressions, aggregates, joins and windows over the
candidates of one document. Positions count code points.

Defined cases: a null text is empty; equal rows get equal spans; rows with one id
and different texts are told apart; spans of several kinds may overlap; an empty
table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgrid.session import broadcast_if_small, materialize

# Kinds in their order, and what each looks like. Quantifiers take all they can and
# look-behinds let a search begin only where the leftmost match could, so long runs stay linear.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SECRET = "secret"
SECRET_WORDS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey")
SECRET_FORM = "AKIA[0-9A-Z]{16}"
WORD = r"(?=[^\s0-9@=:\"'<>]*+[0-9@])[^\s=:\"'<>]++"
CANDIDATE = rf"(?<![^\s=:\"'<>]){WORD}(?: {WORD})*+"
MIN_SECRET = 8
SHAPE_CHARS = 64

PREFIX_BLOCK = 256
CONTEXT_CHARS = 80
ROUNDS = 3
MIN_CONTEXT = 0.8
MIN_CANDIDATE = 0.7
PRIOR = 2.0
FOUND = "array<struct<start:bigint,value:string,before:string,after:string>>"
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"


def located(text: str, pattern: str) -> Column:
    """Array of (start, value, before, after) of all matches in a column: the end of the text since the match before, the beginning of that up to the next.

    Lengths of matches and of what lies between them are summed up in blocks, so
    a text with very many matches is not quadratic.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern), lambda gap: F.struct(
        F.length(gap).cast("long").alias("gap"), F.substring(gap, -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"), F.substring(gap, 1, CONTEXT_CHARS).alias("after")))
    behind = F.zip_with(found, F.slice(gaps, 2, F.size(found)), lambda value, gap: F.struct(value.alias("value"), gap["after"].alias("after")))
    pairs = F.zip_with(gaps, behind, lambda gap, x: F.struct(
        gap["gap"].alias("gap"), x["value"].alias("value"), gap["before"].alias("before"), x["after"].alias("after")))
    pairs = F.filter(pairs, lambda x: x["value"].isNotNull())
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(pairs) / PREFIX_BLOCK).cast("int")), lambda b: b)
    empty = F.array().cast(FOUND)

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        item = F.struct(start.alias("start"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct((start + F.length(x["value"])).alias("at"), F.concat(s["out"], F.array(item)).alias("out"))

    zero = F.lit(0).cast("long").alias("at")
    local = F.transform(blocks, lambda b: F.aggregate(F.slice(pairs, b * PREFIX_BLOCK + 1, F.lit(PREFIX_BLOCK)), F.struct(zero, empty.alias("out")), add))
    offsets = F.aggregate(
        local, F.struct(zero, F.array().cast("array<bigint>").alias("out")),
        lambda s, x: F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
    )["out"]
    return F.flatten(F.zip_with(local, offsets, lambda x, o: F.transform(x["out"], lambda y: F.struct(
        (y["start"] + o).alias("start"), y["value"].alias("value"), y["before"].alias("before"), y["after"].alias("after")))))


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        doubled = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Add ``base``, an array of spans (start, rank, end, kind) in order, and ``candidates`` (start, value, before, after)."""
    guards = {"email": F.col(text).contains("@"), "phone": F.col(text).contains("+")}
    digit = F.col(text).rlike("[0-9]")
    nothing = F.array().cast(FOUND)
    marked = docs.withColumns({
        f"__{kind}": F.when(guards.get(kind, digit), located(text, PATTERNS[kind])).otherwise(nothing) for kind in KINDS
    } | {"candidates": F.when(digit | guards["email"], located(text, CANDIDATE)).otherwise(nothing)})

    def spans(rank: int, kind: str) -> Column:
        return F.transform(F.filter(f"__{kind}", lambda x: valid(kind, x["value"])), lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.length(x["value"])).alias("end"), F.lit(kind).alias("kind")))

    parts = [spans(rank, kind) for rank, kind in enumerate(KINDS)]
    return marked.withColumn("base", F.array_sort(F.concat(*parts))).drop(*(f"__{kind}" for kind in KINDS))


def span_text(spans: str) -> Column:
    """kind:start:end, comma-joined, of a column of spans."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def shape(value: Column) -> Column:
    """What a value with a letter looks like: hexadecimal, capitals or letters with digits, and how long, else class by class."""
    n = F.length(value).cast("string")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "9")
    known = F.when(value.rlike("^[0-9a-f]+$"), F.concat(F.lit("hex "), n)).when(value.rlike("^[0-9A-Z]+$"), F.concat(F.lit("capitals "), n)).when(
        value.rlike("^[0-9A-Za-z]+$"), F.concat(F.lit("letters "), n)).otherwise(classes)
    return F.when(value.rlike("[A-Za-z]") & (F.length(value) <= SHAPE_CHARS), known)


def _is_secret(value: Column, before: Column) -> Column:
    words = "|".join(SECRET_WORDS)
    named = F.lower(before).rlike(rf"(?:^|[^a-z0-9_])(?:{words})\s*[=:]\s*[\"']?$")
    return named & (F.length(value) >= MIN_SECRET) | value.rlike(f"^{SECRET_FORM}$")


def _candidates(found: DataFrame) -> DataFrame:
    """Candidates outside the base spans, and those in which one begins (kind set): __id, __h, start, end, value, kind, contexts."""

    def words_of(text: str) -> Column:
        return F.filter(F.split(F.regexp_replace(F.lower(text), r"[\s=:\"'<>]+", " "), " "), lambda w: w != "")

    words = found.select("__id", "__h", F.explode("candidates").alias("c")).select(
        "__id", "__h", F.col("c.start").alias("start"), (F.col("c.start") + F.length("c.value")).alias("end"), F.col("c.value").alias("value"),
        words_of("c.before").alias("before"), F.get(words_of("c.after"), 0).alias("after"), _is_secret(F.col("c.value"), F.col("c.before")).alias("secret"),
    )
    seeds = found.select("__id", "__h", F.explode("base").alias("b")).select("__id", "__h", "b")
    events = words.select("__id", "__h", (F.col("end") - 1).alias("at"), "start", "end", "value", "before", "after", "secret", F.lit(None).cast(SPAN).alias("b")).unionByName(
        seeds.select("__id", "__h", F.col("b.start").alias("at"), "b"), allowMissingColumns=True)
    so_far = Window.partitionBy("__id", "__h").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = events.withColumns({"last": F.last("b", ignorenulls=True).over(so_far), "reach": F.max("b.end").over(so_far)}).where("value is not null")
    begins = F.coalesce(F.col("last.start") >= F.col("start"), F.lit(False))
    free = begins | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))
    one, two = F.element_at("before", -1), F.concat_ws(" ", F.slice("before", -2, 2))
    contexts = F.array_compact(F.array(
        F.when(F.size("before") >= 1, one), F.when(F.size("before") >= 2, two), F.concat(F.lit("behind: "), "after"), F.concat(F.lit("shape: "), shape(F.col("value")))))
    kind = F.when(begins, F.col("last.kind")).when(F.col("secret"), F.lit(SECRET))
    return ranked.where(free).select("__id", "__h", "start", "end", "value", kind.alias("kind"), contexts.alias("contexts"))


def score_contexts(candidates: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(context, kind, score) from candidates (value, kind or null, contexts) by rounds over the context-candidate graph."""
    edges = materialize(candidates.select(F.explode("contexts").alias("context"), "value", "kind").distinct(), "graph")
    seeds = edges.where("kind is not null").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    pairs = edges.select("context", "value").distinct()
    degree = pairs.groupBy("context").agg(F.count(F.lit(1)).alias("n"))
    values, contexts = seeds, None
    for _ in range(rounds):
        summed = pairs.join(values, "value").groupBy("context", "kind").agg(F.sum("score").alias("s"))
        contexts = materialize(summed.join(degree, "context").select("context", "kind", (F.col("s") / (F.col("n") + PRIOR)).alias("score")), "contexts")
        learnt = pairs.join(contexts.where(F.col("score") >= MIN_CANDIDATE), "context").groupBy("value", "kind").agg(F.max("score").alias("score"))
        values = seeds.union(learnt.join(seeds.select("value").distinct(), "value", "left_anti"))
    return contexts


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ``base`` and ``spans`` (both arrays of start, rank, end, kind in order) of every document."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = materialize(
        base_spans(docs.select(F.col(id_col).alias("__id"), whole.alias("__t")), "__t").withColumn("__h", F.xxhash64("__t")).drop("__t"), "spans")
    candidates = materialize(_candidates(found).distinct(), "identifiers")
    contexts = score_contexts(candidates).where(F.col("score") >= MIN_CONTEXT)
    best = candidates.where("kind is null").select("__id", "__h", "start", "end", F.explode("contexts").alias("context")).join(
        broadcast_if_small(contexts), "context")
    rank = F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), F.col("kind")).cast("int") - 1
    chosen = best.groupBy("__id", "__h", "start", "end").agg(F.max_by("kind", F.struct("score", -rank)).alias("kind")).union(
        candidates.where(F.col("kind") == SECRET).select("__id", "__h", "start", "end", "kind"))
    span = F.struct("start", rank.alias("rank"), "end", "kind")
    added = materialize(chosen.groupBy("__id", "__h").agg(F.collect_list(span).alias("added")), "added")
    added = broadcast_if_small(added.select(F.col("__id").alias("__i"), F.col("__h").alias("__j"), "added"))
    joined = found.join(added, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__j")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>"))))
    return joined.select(F.col("__id").alias(id_col), "base", every.alias("spans"))
