"""Text keys and answer checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that agree with Unicode-aware word and space matching.
SPACE = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]+"
NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"

# Words that do not count when two answers are compared.
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were",
    "in", "on", "at", "to", "of", "and", "or",
    "for", "it", "its", "this", "that", "with",
    "as", "by", "be", "has", "had", "have", "from",
)

# Question openings and what replaces them.
REWRITES = (
    ("What is ", "Define "),
    ("What are ", "List "),
    ("Who is ", "Tell me about "),
    ("Who was ", "Identify the person known as "),
    ("When did ", "In which year did "),
    ("Where is ", "What is the location of "),
    ("How many ", "What's the count of "),
    ("How does ", "Explain the functioning of "),
    ("Why do ", "What causes "),
    ("Why is ", "What explains "),
    ("Can you ", ""),
    ("Could you ", ""),
    ("Please ", ""),
    ("Tell me ", "What is "),
    ("I want to know ", ""),
    ("I'd like to know ", ""),
)

# Openings put before a question that no rewrite matches.
LEAD_INS = (
    "Here's a question: ",
    "I need to know: ",
    "Quick question: ",
    "Mind telling me ",
    "Curious about ",
    "Looking for info on ",
)


def collapse_spaces(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, SPACE, " "))


def normalize_text(col: Column) -> Column:
    """Lower case, punctuation removed, white space collapsed."""
    return collapse_spaces(F.regexp_replace(F.lower(col), NOT_WORD_OR_SPACE, ""))


def normalize_light(col: Column) -> Column:
    """Lower case and white space collapsed; punctuation kept."""
    return collapse_spaces(F.lower(col))


def exact_key(text: Column, tenant: Column) -> Column:
    """Key of the exact tier: tenant in braces, then the hash of the normalised text."""
    return F.concat(F.lit("{"), tenant, F.lit("}:exact:"), F.sha2(normalize_text(text), 256))


def memo_key(text: Column) -> Column:
    """Key under which the vector of a text is shared between tenants."""
    return F.sha2(normalize_text(text), 256)


def short_id(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 12)


def words(col: Column) -> Column:
    return F.filter(F.split(collapse_spaces(F.lower(col)), " "), lambda w: w != "")


def word_count(col: Column) -> Column:
    return F.size(F.filter(F.split(collapse_spaces(col), " "), lambda w: w != ""))


def seeded_hash(seed: int, col: Column) -> Column:
    """Non-negative number below 2^32 drawn from a seed and a value."""
    return F.conv(
        F.substring(F.md5(F.concat(F.lit(f"{seed}:"), col.cast("string"))), 1, 8), 16, 10
    ).cast("bigint")


def answer_match(expected: Column, answer: Column) -> Column:
    """Does a cached answer contain what was expected (substring, overlap, key terms)?"""
    want, have = F.trim(collapse_edges(F.lower(expected))), F.lower(answer)
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    want_words = F.array_except(F.array_distinct(words(expected)), stop)
    have_words = F.array_except(F.array_distinct(words(answer)), stop)
    long_words = F.filter(want_words, lambda w: F.length(w) > 3)
    overlap = F.size(F.array_intersect(want_words, have_words)) / F.size(want_words)
    return (
        F.contains(have, want)
        | (F.size(want_words) == 0)
        | F.coalesce(overlap >= F.lit(0.35), F.lit(False))
        | F.exists(long_words, lambda w: F.contains(have, w))
    )


def collapse_edges(col: Column) -> Column:
    """White space stripped at both ends only."""
    return F.regexp_replace(col, f"^{SPACE}|{SPACE}$", "")


def word_overlap_match(expected: Column, answer: Column, least: float = 0.3) -> Column:
    want, have = F.array_distinct(words(expected)), F.array_distinct(words(answer))
    overlap = F.size(F.array_intersect(want, have)) / F.size(want)
    return (F.size(want) == 0) | F.coalesce(overlap >= F.lit(least), F.lit(False))


def paraphrase(question: Column, pick: Column) -> Column:
    """Rewrite the opening of a question; ``pick`` chooses the lead-in if no rewrite matches."""
    leads = F.array(*[F.lit(x) for x in LEAD_INS])
    text = F.concat(
        F.element_at(leads, (F.pmod(pick, F.lit(len(LEAD_INS))) + 1).cast("int")),
        F.lower(F.substring(question, 1, 1)),
        F.substring(question, 2, 2_147_483_647),
    )
    for opening, replacement in reversed(REWRITES):
        text = F.when(
            F.lower(F.substring(question, 1, len(opening))) == opening.lower(),
            F.concat(F.lit(replacement), F.substring(question, len(opening) + 1, 2_147_483_647)),
        ).otherwise(text)
    bare = collapse_edges(F.regexp_replace(text, r"\?+$", ""))
    return F.when(bare.endswith(".") | bare.endswith("!"), bare).otherwise(F.concat(bare, F.lit("?")))
