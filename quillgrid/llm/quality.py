"""Document quality by weak supervision.

Rules read counts of a document and vote that it is good, bad, or abstain.
Expectation-maximisation estimates, for each rule and class, how often it gives
each of the three votes, and the share of good documents; a document is kept if
its posterior probability of being good is at least ``threshold``. No labels are read.

What the classes mean is fixed by anchors: patterns of votes with ``ANCHOR_GOOD``
good votes and no bad one count as good, those with ``ANCHOR_BAD`` bad votes as
bad, while the rest are estimated. The verdict is the posterior of the fitted
model for every document, anchors too. A bad vote thus weighs as much as it tells
the classes apart: one of a weak rule does not drop a document that the others
call good, and one of a sure rule does whatever the others say.

Only built-in expressions run on the executors. One scan writes the counts of
each document to the shared folder and counts the distinct patterns of votes;
those, at most 3 ** rules rows whatever the corpus holds, are all that the
iterations need.

Defined cases: a null or blank text has no words and fails the base rule; an
empty table gives no rows; repeated rows are judged alike; other columns,
whatever their names, are not touched or returned; a null id stays null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from quillgrid.session import materialize

# White space between words, and the characters that count as symbols.
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ROUNDS = 500
TOLERANCE = 1e-9
# What is believed of a rule before any document is seen, as counts of documents by vote.
BELIEVED_GOOD = {-1: 0.5, 0: 4.0, 1: 15.5}
BELIEVED_BAD = {-1: 8.0, 0: 4.0, 1: 8.0}
ANCHOR_GOOD = 8
ANCHOR_BAD = 3
THRESHOLD = 0.5
GOOD, BAD, ABSTAIN = 1, -1, 0
VOTES = (BAD, ABSTAIN, GOOD)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(first: DataFrame) -> DataFrame:
    """Add n_repeat_words to rows with ``words``: words inside three-word windows that occur twice or more.

    Windows are compared by a 64-bit hash. Documents whose windows are all
    different, found by one hash set, skip the sort.
    """
    n = F.greatest(F.size("words") - 2, F.lit(0))
    two = F.zip_with(F.slice("words", 1, n), F.slice("words", 2, n), lambda a, b: F.xxhash64(a, b))
    windows = first.withColumn(
        "windows", F.zip_with(two, F.slice("words", 3, n), lambda a, b: F.xxhash64(a, b))
    ).withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    ordered = windows.withColumn(
        "ordered",
        F.when(F.col("repeats"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    after = F.zip_with(
        "ordered", F.expr("slice(ordered, 2, size(ordered))"),
        lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), b["h"].alias("next")),
    )
    before = F.expr("concat(array(cast(null as struct<h:bigint,i:int>)), slice(ordered, 1, size(ordered) - 1))")
    starts = ordered.withColumn("starts", F.sort_array(F.array_compact(F.zip_with(
        after, before, lambda a, b: F.when(a["h"].eqNullSafe(a["next"]) | a["h"].eqNullSafe(b["h"]), a["i"])
    ))))
    covered = F.zip_with(
        "starts", F.expr("slice(starts, 2, size(starts))"), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))
    )
    return starts.withColumn(
        "n_repeat_words",
        F.when(F.col("repeats"), F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0)).cast("long"),
    ).drop("windows", "repeats", "ordered", "starts")


def measure(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """The counts that rules read, one row per document, without its text; ``keep`` names columns to carry."""
    base = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    split = base.withColumns({
        "words": F.array_remove(F.split("__t", WORD_GAP), ""),
        "lines": F.filter(F.split("__t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    })

    def without(pattern: str) -> Column:
        return F.length("__t") - F.length(F.regexp_replace("__t", pattern, ""))

    counted = _repeat_words(split).withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_letters": without(r"\p{L}+").cast("long"),
        "n_upper": without(r"\p{Lu}+").cast("long"),
        "n_marks": (F.length("__t") - F.length(F.translate("__t", "!?", ""))).cast("long"),
        "n_digits": without("[0-9]+").cast("long"),
        "n_stops": (F.length("__t") - F.length(F.translate("__t", ".", ""))).cast("long"),
    })
    return counted.drop("__t", "words", "lines")


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN))


def rules() -> dict[str, Column]:
    """Votes by name, over the columns of ``measure``: bad beyond a limit, good well inside it, none between."""
    mean = _ratio("word_chars", "n_words")
    stops = _ratio("n_stops", "n_words")
    symbols, share = _ratio("n_symbols", "n_words"), _ratio("n_symbols", "word_chars")
    same_lines = _ratio("n_dup_lines", "n_lines")
    repeats = _ratio("n_repeat_words", "n_words")
    capitals = _ratio("n_upper", "n_letters")
    marks = _ratio("n_marks", "n_words")
    digits = _ratio("n_digits", "word_chars")
    letters = _ratio("n_letters", "word_chars")
    return {
        "length": _vote(F.col("n_words") < MIN_WORDS, F.col("n_words") >= 2 * MIN_WORDS),
        "sentences": _vote(stops < 0.01, (stops >= 0.04) & (stops <= 0.3)),
        "word_length": _vote((mean < 3) | (mean > 7), (mean >= 4) & (mean <= 6)),
        "symbols": _vote(symbols > 0.1, symbols <= 0.02),
        "symbol_share": _vote(share > 0.05, share <= 0.01),
        "lines": _vote(same_lines > 0.3, (F.col("n_lines") >= 3) & (same_lines <= 0.1)),
        "repeats": _vote(repeats > 0.3, (F.col("n_words") >= 20) & (repeats <= 0.1)),
        "capitals": _vote(capitals > 0.3, (F.col("n_letters") > 0) & (capitals <= 0.1)),
        "marks": _vote(marks > 0.3, marks <= 0.05),
        "digits": _vote(digits > 0.3, digits <= 0.1),
        "letters": _vote(letters < 0.8, letters >= 0.9),
    }


def anchor(votes: tuple[int, ...]) -> float | None:
    """1 for a pattern that stands for good, 0 for bad, None if the model is to say."""
    bad = votes.count(BAD)
    if bad >= ANCHOR_BAD:
        return 0.0
    return 1.0 if not bad and votes.count(GOOD) >= ANCHOR_GOOD else None


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = ROUNDS) -> tuple[float, dict[str, dict[int, float]]]:
    """Expectation-maximisation over the distinct vote patterns and how many documents have each.

    Returns the prior log-odds of good and, by rule and vote (abstaining too), the
    log of how much likelier the vote is for a good document. Patterns that are no
    anchors start at odds of three to one, divided by nine for each bad vote: a rule
    is believed until the votes of the others speak against it.
    """
    step = math.log(9.0)
    fixed = {votes: anchor(votes) for votes, _ in patterns}
    odds = {votes: step / 2 - step * votes.count(BAD) for votes, _ in patterns}
    prior, weights = 0.0, {name: dict.fromkeys(VOTES, 0.0) for name in names}
    before: dict[tuple[int, ...], float] = {}
    for _ in range(rounds if patterns else 0):
        p = {votes: 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, odds[votes])))) if fixed[votes] is None else fixed[votes] for votes, _ in patterns}
        if before and max(abs(p[votes] - before[votes]) for votes in p) < TOLERANCE:
            break
        before = p
        good = {votes: n * p[votes] for votes, n in patterns}
        bad = {votes: n * (1.0 - p[votes]) for votes, n in patterns}
        all_good, all_bad = math.fsum(good.values()), math.fsum(bad.values())
        more_good, more_bad = sum(BELIEVED_GOOD.values()), sum(BELIEVED_BAD.values())
        prior = math.log((all_good + 1.0) / (all_bad + 1.0))
        for k, name in enumerate(names):
            for vote in VOTES:
                g = math.fsum(x for votes, x in good.items() if votes[k] == vote)
                b = math.fsum(x for votes, x in bad.items() if votes[k] == vote)
                weights[name][vote] = math.log((g + BELIEVED_GOOD[vote]) / (all_good + more_good) * (all_bad + more_bad) / (b + BELIEVED_BAD[vote]))
        odds = {votes: prior + sum(weights[name][v] for name, v in zip(names, votes)) for votes, _ in patterns}
    return prior, weights


def _odds(prior: float, weights: dict[str, dict[int, float]]) -> Column:
    odds = F.lit(prior)
    for name, by_vote in weights.items():
        odds = odds + F.when(F.col(name) == GOOD, by_vote[GOOD]).when(F.col(name) == BAD, by_vote[BAD]).otherwise(by_vote[ABSTAIN])
    return odds


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """Counts, votes, posterior and verdict of every document."""
    votes = rules()
    names = list(votes)
    measured = materialize(measure(docs, text, *keep).withColumns(votes), "quality")
    patterns = [(tuple(row[:-1]), row[-1]) for row in measured.groupBy(*names).count().orderBy(*names).collect()]
    prior, weights = fit_votes(patterns, names)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = measured.withColumns({
        "p_good": F.lit(1.0) / (F.lit(1.0) + F.exp(-_odds(prior, weights))), "base_failed": base_failed,
    })
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
