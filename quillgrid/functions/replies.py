"""Prompts for zero-shot classification and the reading of replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from quillgrid.functions.text import SPACES, space_tokens
from quillgrid.settings import CLASS_NAMES

# Fixed value: the wording of the prompt, around the class list and the text.
PROMPT_HEAD = "Classify the following document into exactly one of these categories: "
PROMPT_DOCUMENT = ".\n\nDocument:\n"
PROMPT_RULES = (
    "\n\nRules:\n- Reply with ONLY the category name.\n"
    "- Do not add any explanation, punctuation, or extra words.\nCategory:"
)
# Fixed value: how much of a class name the first token of a reply must start with.
PREFIX_LENGTH = 4


def class_name(label: Column, names: dict[int, str] = CLASS_NAMES) -> Column:
    """Name of a numeric class code; any other label is its own name."""
    text = label.cast("string")
    lookup = F.create_map(*[F.lit(item) for pair in names.items() for item in pair])
    code = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    return F.coalesce(F.element_at(lookup, code), text)


def prompt(text: Column, classes: Sequence[str], max_tokens: int | None = None) -> Column:
    """The prompt for one document; ``max_tokens`` cuts it to its first words."""
    words = space_tokens(text)
    head = F.array_join(words if max_tokens is None else F.slice(words, 1, max_tokens), " ")
    return F.concat(F.lit(PROMPT_HEAD + ", ".join(classes) + PROMPT_DOCUMENT), head, F.lit(PROMPT_RULES))


def read_reply(reply: Column, classes: Sequence[str]) -> Column:
    """Struct ``(class_name, class_index, status)`` of one reply.

    Tried in turn, each in class order: the whole reply is a class, a class is
    inside the reply, the first token starts like a class. A reply that fits
    none has no class and the status ``default``; a missing one is an ``error``.
    """
    text = F.lower(F.regexp_replace(reply, f"^{SPACES}|{SPACES}$", ""))
    first = F.get(space_tokens(text), 0)
    rules = (
        ("exact", lambda name: text == F.lit(name)),
        ("contains", lambda name: text.contains(name)),
        ("prefix", lambda name: first.startswith(name[:PREFIX_LENGTH])),
    )
    found = F.lit(None).cast("struct<class_name:string,class_index:int,status:string>")
    for status, matches in reversed(rules):
        for index, name in reversed(list(enumerate(classes))):
            answer = F.struct(
                F.lit(name).alias("class_name"),
                F.lit(index).alias("class_index"),
                F.lit(status).alias("status"),
            )
            found = F.when(matches(name.lower()), answer).otherwise(found)
    nothing = F.struct(
        F.lit(None).cast("string").alias("class_name"),
        F.lit(None).cast("int").alias("class_index"),
        F.when(reply.isNull(), F.lit("error")).otherwise(F.lit("default")).alias("status"),
    )
    return F.coalesce(found, nothing)


def one_hot(prediction: Column, classes: int) -> Column:
    """Probability 1 at the predicted class, 0 elsewhere."""
    return F.array(*[F.coalesce(prediction == i, F.lit(False)).cast("double") for i in range(classes)])
