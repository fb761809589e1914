"""White space, tokens, sentences and numbers in texts, as native column expressions.

The variants differ on purpose: each belongs to one consumer, and their counts are not comparable.
Character classes are spelt out so that they mean the same in Java, RE2 and Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.isspace sees it.
WS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"

# fixed values: patterns of the token variants
LETTERS_TOKEN = r"[A-Za-z']+"
CHANGE_TOKEN = r"[\p{L}\p{N}_']+"
REVIEW_TOKEN = r"[a-z0-9']+"
CONTENT_TOKEN = r"[A-Za-z][A-Za-z'-]*"
OVERLAP_TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}'’./\-]*"
YEAR = r"\b(?:1[5-9]\d\d|20[0-2]\d)\b"
NUMBER = r"\d[\d,.]*"

# fixed values: words that don't identify a sentence when answers are dealt to paragraphs
OVERLAP_STOP_WORDS = (
    "a an the and or but of in on at to for from by with as is are was were be been being it its this that these those they them "
    "their he she his her him you your i we us our not no nor so if then than there here which who whom whose what when where how "
    "why can could will would shall should may might must do does did done have has had also more most other such about into over "
    "under after before between"
).split()

# fixed values: words without content when examples are chosen
CONTENT_STOP_WORDS = (
    "a an and are as at be been but by for from had has have he her his in is it its of on or she that the their they this to was "
    "were which with you your usually also other not can will would"
).split()


def let(value: Column, f) -> Column:
    """f of a value that is worked out once: an expression named inside a lambda would be worked out
    again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", " "))


def stripped(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WS}+|{WS}+$", "")


def word_list(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(collapsed(text), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_list(text))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def letter_tokens(text: Column) -> Column:
    return _all(text, LETTERS_TOKEN)


def change_tokens(text: Column) -> Column:
    return _all(F.lower(text), CHANGE_TOKEN)


def review_tokens(text: Column) -> Column:
    return _all(F.lower(text), REVIEW_TOKEN)


def content_tokens(text: Column) -> Column:
    """Distinct content words, for choosing examples."""
    words = F.array_distinct(F.transform(_all(text, CONTENT_TOKEN), F.lower))
    return F.filter(words, lambda w: ~w.isin(CONTENT_STOP_WORDS))


def overlap_tokens(text: Column) -> Column:
    """Distinct identifying words, for dealing an answer to paragraphs."""
    return F.filter(F.array_distinct(_all(F.lower(text), OVERLAP_TOKEN)), lambda w: ~w.isin(OVERLAP_STOP_WORDS))


def years(text: Column) -> Column:
    return F.array_distinct(_all(text, YEAR))


def numbers(text: Column) -> Column:
    return F.array_distinct(_all(text, NUMBER))


def estimated_tokens(text: Column, per_word: float = 1.6) -> Column:
    return F.ceil(word_count(text) * F.lit(per_word)).cast("long")


def overlap_norm(text: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space, trimmed. Compatibility forms are
    folded first by prosemill.sources.unicode where texts aren't ASCII."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def sha16(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def ngrams(tokens: Column, n: int) -> Column:
    """n-grams as space-joined strings, repeats kept."""

    def of(t: Column) -> Column:
        count = F.size(t) - (n - 1)
        at = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(t, i, n), " "))

    return let(tokens, of)


def has_loop(text: Column, n: int = 5, times: int = 3) -> Column:
    """Whether any n-gram of review tokens comes ``times`` times or more."""

    def of(grams: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(grams) - (times - 1), F.lit(1)))
        return (F.size(grams) >= times) & F.exists(at, lambda i: F.get(grams, i - 1) == F.get(grams, i + (times - 2)))

    return let(F.array_sort(ngrams(review_tokens(text), n)), of)


# --------------------------------------------------------------------------- sentences

def review_sentences(text: Column) -> Column:
    """Cut at white space after one of .!?"""
    return F.filter(F.split(stripped(text), f"(?<=[.!?]){WS}+"), lambda s: s != "")


def serving_sentences(text: Column) -> Column:
    """What is sent to a sentence model: as review_sentences, but bodies with line breaks or tabs are
    cut at every white space. It stands in for a statistical segmenter, which can be plugged in."""
    broken = F.split(stripped(text), f"{WS}+")
    plain = F.split(stripped(text), f"(?<=[.!?]){WS}+")
    return F.filter(F.when(stripped(text).rlike(r"[\n\r\t]"), broken).otherwise(plain), lambda s: s != "")


def answer_sentences(text: Column) -> Column:
    """White space after .?! and an optional closing quote, or none before a capital unless a single
    letter precedes the mark."""
    pattern = r"(?<=[.?!]|[.?!][\"'”’)\]])\s+|(?<!(?<!\p{L})\p{L}[.?!])(?<=[.?!])(?=\p{Lu})"
    return F.filter(F.transform(F.split(stripped(text), pattern), stripped), lambda s: s != "")


def ending_marks(text: Column) -> Column:
    """How many runs of .!? end a sentence, at least 1."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[.!?]+(?=\s|$)")), F.lit(1))


def ptb_sentences(text: Column) -> Column:
    """Sentences of tokenised text: the number of marks . ? ! that are tokens, plus a tail."""
    tokens = F.filter(F.split(stripped(text), f"{WS}+"), lambda w: w != "")
    marks = F.size(F.filter(tokens, lambda w: w.isin(".", "?", "!")))
    tail = F.when((F.size(tokens) > 0) & ~F.element_at(tokens, -1).isin(".", "?", "!"), 1).otherwise(0)
    return F.when(F.size(tokens) > 0, marks + tail).otherwise(0)
