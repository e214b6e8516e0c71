"""Text cleaning, tokens and word n-grams as column expressions.

No expression here refers to an outer column from inside a lambda: Catalyst may
inline that column's definition into the lambda and evaluate it once per element.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as white space, the cleaning patterns
# in the order they apply, and the token patterns. All valid in Java and RE2.
# The last cleaning pattern takes runs of white space and of dropped characters
# together: both end as one space.
SPACE_CHARS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACES = f"[{SPACE_CHARS}]+"
NON_SPACE = f"[^{SPACE_CHARS}]"
CLEANING_PATTERNS = (
    r"<[^>]+>",
    f"http{NON_SPACE}+|www{NON_SPACE}+",
    r"[^a-z0-9.,!?']+",
)
# What the last cleaning pattern leaves: this class is matched several times faster than its complement.
KEPT = r"[a-z0-9.,!?']+"
TOKEN_PATTERNS = {
    "default": r"[a-z0-9]{2,}",
    "strict": r"\b[a-z][a-z0-9]{2,}\b",
}


def clean_text(text: Column) -> Column:
    """Lower case, no markup, no addresses, only ``a-z0-9.,!?'`` and single spaces."""
    cleaned = F.lower(text)
    for pattern in CLEANING_PATTERNS[:-1]:
        cleaned = F.regexp_replace(cleaned, pattern, " ")
    return F.array_join(F.regexp_extract_all(cleaned, F.lit(KEPT), F.lit(0)), " ")


def has_text(text: Column) -> Column:
    """True if at least one character is not white space."""
    return text.rlike(NON_SPACE)


def space_tokens(cleaned: Column) -> Column:
    """Tokens between spaces, punctuation attached; empty text has none."""
    return F.filter(F.split(cleaned, SPACES), lambda token: token != "")


def pattern_tokens(cleaned: Column, kind: str = "default") -> Column:
    """Tokens of cleaned text that match a named pattern."""
    return F.regexp_extract_all(cleaned, F.lit(TOKEN_PATTERNS[kind]), F.lit(0))


def tokens(cleaned: Column, kind: str) -> Column:
    return space_tokens(cleaned) if kind == "space" else pattern_tokens(cleaned, kind)


def word_ngrams(words: Column, low: int, high: int) -> Column:
    """All n-grams of ``low`` to ``high`` words, each joined by one space."""
    count = F.size(words)
    grams, collected = words, []
    for n in range(1, high + 1):
        if n > 1:
            # Extend each (n-1)-gram by the word after it.
            length = F.greatest(count - F.lit(n - 1), F.lit(0))
            grams = F.zip_with(
                F.slice(grams, F.lit(1), length),
                F.slice(words, F.lit(n), length),
                lambda gram, word: F.concat(gram, F.lit(" "), word),
            )
        if n >= low:
            collected.append(grams)
    return collected[0] if len(collected) == 1 else F.concat(*collected)
