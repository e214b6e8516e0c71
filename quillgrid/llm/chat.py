"""Chat records as windows of a token budget.

Turns are marked as ``<turn role>``, text, ``</turn>`` and a line break. In roles
and texts a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and ``>`` becomes ``\\g``, so no text can hold a mark and
every text can be read back.

Prefix sums of turn tokens (words plus a fixed cost of the marks) place turns on
a line of tokens, cut into pieces of half the room that the system turn and the
history leave of the budget: turns that start in one piece form a span, so a span
fits the room and its window the budget. A turn longer than a piece is a span of
its own; a window exceeds the budget only if its one turn, with the system turn
and the history, is longer alone. A turn is never cut. Each window holds the system turn that opens
its conversation, then the turns of the span before it that start within
``history`` tokens of its own start, then its own span. Only assistant turns of
the own span are under the loss mask: repeated turns are never targets, so each
assistant text is a target once.

The prefix sum runs in two steps, blocks of ``BLOCK`` turn numbers and turns in a block,
so a conversation of any length is not one task. All steps are built-in
expressions; the text of a turn moves once, to its windows.

Defined cases: null texts and roles are empty; equal turn numbers go by role and
text; a null turn number comes first; a null conversation id is a conversation
of its own; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgrid.session import materialize

BUDGET = 512
HISTORY = 64
MARK_TOKENS = 4
BLOCK = 1024
SYSTEM, TARGET = "system", "assistant"
TURN = r"<turn ([^<>]*)>([^<>]*)</turn>\n"


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with their number, tokens before them, and the opening system turn told apart."""
    base = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumns({
        "block": F.floor(F.col("turn") / BLOCK),
        "tokens": (F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")) + MARK_TOKENS).cast("long"),
    })
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    blocks = base.groupBy("conv_id", "block").agg(F.sum("tokens").alias("block_tokens"), F.count(F.lit(1)).alias("block_turns"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        F.col("conv_id").alias("__c"), F.col("block").alias("__b"),
        F.coalesce(F.sum("block_tokens").over(before), F.lit(0)).alias("block_start"),
        F.coalesce(F.sum("block_turns").over(before), F.lit(0)).alias("block_number"),
    )
    local = base.withColumns({
        "start": F.coalesce(F.sum("tokens").over(in_block), F.lit(0)), "number": F.coalesce(F.count(F.lit(1)).over(in_block), F.lit(0)),
    })
    joined = local.join(offsets, local["conv_id"].eqNullSafe(offsets["__c"]) & local["block"].eqNullSafe(offsets["__b"]))
    return joined.withColumns({
        "start": F.col("start") + F.col("block_start"), "number": F.col("number") + F.col("block_number"),
    }).withColumn("opens", (F.col("number") == 0) & (F.col("role") == SYSTEM)).drop("__c", "__b", "block_start", "block_number", "block", "turn")


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text).

    conv_id, window_start (tokens before its own turns), text, n_repeated (turns
    at the head that an earlier window had), n_tokens, and loss_spans, (start, end)
    of the target characters in text.
    """
    placed = materialize(_placed(turns), "turns")
    total = placed.groupBy(F.col("conv_id").alias("__c")).agg(
        F.max(F.col("start") + F.col("tokens")).alias("all_tokens"), F.coalesce(F.max(F.when(F.col("opens"), F.col("tokens"))), F.lit(0)).alias("system_tokens"))
    placed = placed.join(total, F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")
    piece = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("system_tokens")) / 2))
    # A long turn ends the span before it and starts another behind it, at its own end on the line of tokens.
    spans = placed.withColumn("long", F.col("tokens") > piece)
    block = F.floor(F.col("start") / piece)
    near = Window.partitionBy("conv_id", "piece_no").orderBy("start")
    lined = spans.withColumn("piece_no", block).withColumn(
        "after_long", F.coalesce(F.max(F.when(F.col("long"), F.col("start") + F.col("tokens"))).over(
            near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    keys = ["conv_id", "piece_no", "after_long", "long"]
    whole = Window.partitionBy(*keys)
    formatted = lined.withColumns({
        "window_start": F.min("start").over(whole), "window_end": F.max(F.col("start") + F.col("tokens")).over(whole),
        "head": F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">")), "body": escape(F.col("text")),
    })
    repeats = (F.col("window_end") - F.col("start") <= history) & (F.col("window_end") < F.col("all_tokens")) & ~F.col("opens")
    own = F.struct(F.col("window_start").alias("window"), F.lit(False).alias("again"))
    next_one = F.struct(F.col("window_end").alias("window"), F.lit(True).alias("again"))
    spread = formatted.withColumn("at", F.explode(F.when(repeats, F.array(own, next_one)).otherwise(F.array(own)))).select(
        "conv_id", F.col("at.window").alias("window_start"), F.col("at.again").alias("again"), "number", "head", "body", "role", "tokens"
    )
    openings = formatted.where("opens").select(F.col("conv_id").alias("__c"), F.col("head").alias("__h"), F.col("body").alias("__b"), F.col("window_start").alias("__w"), F.col("tokens").alias("__t"))
    first_windows = formatted.select("conv_id", "window_start").distinct()
    retained = first_windows.join(openings, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("window_start") != F.col("__w"))).select(
        "conv_id", "window_start", F.lit(True).alias("again"), F.lit(0).cast("long").alias("number"),
        F.col("__h").alias("head"), F.col("__b").alias("body"), F.lit(SYSTEM).alias("role"), F.col("__t").alias("tokens"),
    )
    grouped = spread.union(retained).groupBy("conv_id", "window_start").agg(F.sort_array(F.collect_list(F.struct(
        "number", "again", "head", "body", (~F.col("again") & (F.col("role") == TARGET)).alias("target")))).alias("rows"), F.sum("tokens").alias("n_tokens"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    tail = len("</turn>\n")

    def walk(s: Column, row: Column) -> Column:
        begin = s["at"] + F.length(row["head"])
        end = begin + F.length(row["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + tail).alias("at"), F.when(row["target"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return grouped.select(
        "conv_id", "window_start",
        F.array_join(F.transform("rows", lambda r: F.concat(r["head"], r["body"], F.lit("</turn>\n"))), "").alias("text"),
        F.size(F.filter("rows", lambda r: r["again"])).alias("n_repeated"), "n_tokens", F.aggregate("rows", start, walk)["spans"].alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Windows with the turns they hold anew (array of role, text) and target_text, read from their text alone and its spans."""
    roles, texts = (F.regexp_extract_all("text", F.lit(TURN), F.lit(g)) for g in (1, 2))
    turns = F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))
    lined = windows.withColumn("turns", turns).withColumn("turns", F.expr("slice(turns, n_repeated + 1, greatest(size(turns) - n_repeated, 0))"))
    pieces = F.transform(F.arrays_zip("loss_spans", F.array_repeat("text", F.size("loss_spans"))), lambda x: F.substr(
        x["1"], (x["loss_spans"]["start"] + 1).cast("int"), (x["loss_spans"]["end"] - x["loss_spans"]["start"]).cast("int")))
    return lined.withColumn("target_text", unescape(F.array_join(pieces, "")))


def read_conversations(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_text (role, line break, text, line break for each turn), loss_text and formatted_chars."""
    told = read_windows(windows).select(
        "conv_id", "window_start", F.size("turns").alias("n"), "target_text", F.length("text").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("told"),
    )
    grouped = told.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window_start", "told", "target_text"))).alias("rows"),
    )
    return grouped.select(
        "conv_id", "n_turns", F.array_join(F.transform("rows", lambda r: r["told"]), "").alias("turns_text"),
        F.array_join(F.transform("rows", lambda r: r["target_text"]), "").alias("loss_text"), "formatted_chars",
    )
