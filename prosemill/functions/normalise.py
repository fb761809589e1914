"""Between ordinary prose and the lower-case, tokenised form that document models take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosemill.functions.text import WS, collapsed, let, stripped

_LONE = r"(?<!\p{L})\p{L}"  # a letter that no letter precedes
#: Patterns and replacements in order; (?U) makes \w and \s mean what they mean in Python.
FORWARD = (
    (r"(?U)(\w)'(s\b|\s|$)", "$1 '$2"),
    (r"([;:!?()\[\]])", " $1 "),
    (r"(?U)(?<!\d),|,(?!\d)", " , "),
    (rf"(?U)(?<!\d)(?<!{_LONE})\.|(?<!{_LONE})\.(?!\d)", " . "),
)
BACKWARD = (
    (r"``\s*", '"'),
    (r"\s*''", '"'),
    (r"\(\s*\)", " "),
    (r"\s+'(s\b)", "'$1"),
    (r"\s+([,.;:!?)\]])", "$1"),
    (r"([(\[])\s+", "$1"),
    (rf"(?<!{_LONE})([.?!])(?=\p{{L}})", "$1 "),
    (r"([,;])(?=\p{L})", "$1 "),
)


def with_full_stop(text: Column) -> Column:
    """Ends in . ? or !, unless empty; trailing white space goes."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+$", "")
    return F.when((t == "") | t.rlike("[.?!]$"), t).otherwise(F.concat(t, F.lit(".")))


def joined_segments(segments: Column) -> Column:
    return F.array_join(F.filter(F.transform(segments, with_full_stop), lambda s: s != ""), " ")


def for_model(text: Column) -> Column:
    """Lower case; quotes alternate between `` and ''; marks stand alone except in numbers and
    single-letter abbreviations."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), '["“”]')
    quoted = F.array_join(
        F.transform(parts, lambda x, i: F.when(i == 0, x).when(i % 2 == 1, F.concat(F.lit(" `` "), x)).otherwise(F.concat(F.lit(" '' "), x))), ""
    )
    return collapsed(reduce(lambda t, r: F.regexp_replace(t, *r), FORWARD, quoted))


def casing(source: Column) -> Column:
    """Map from lower case to the first capitalised form met inside a sentence."""
    tokens = F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(r"\p{L}+|[.?!]"), F.lit(0))

    def named(t: Column) -> Column:
        inside = F.transform(t, lambda x, i: F.struct(x.alias("t"), F.coalesce(~F.get(t, i - 1).rlike("^[.?!]$") & (i > 0), F.lit(False)).alias("mid")))
        return F.filter(inside, lambda x: x["mid"] & x["t"].rlike(r"^\p{Lu}"))

    def as_map(names: Column) -> Column:
        keys = F.array_distinct(F.transform(names, lambda x: F.lower(x["t"])))
        return let(keys, lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda k: F.get(F.filter(names, lambda x: F.lower(x["t"]) == k), F.lit(0))["t"])))

    return let(let(tokens, named), as_map)


def from_model(text: Column, source: Column) -> Column:
    """Marks and quotes attached again, names cased as in the source, sentences capitalised."""
    t = collapsed(reduce(lambda t, r: F.regexp_replace(t, *r), BACKWARD, F.coalesce(text, F.lit(""))))
    pieces = F.regexp_extract_all(t, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    cased = let(casing(source), lambda known: F.transform(pieces, lambda p: F.coalesce(F.element_at(known, F.lower(p)), p)))

    def capitals(words: Column) -> Column:
        first = lambda i: (i == 0) | ((i == 1) & ~F.get(words, F.lit(0)).rlike(r"^\p{L}"))
        after = lambda i: F.coalesce((i > 0) & F.get(words, i - 1).rlike("[.?!]"), F.lit(False))
        upper = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))
        return F.transform(words, lambda p, i: F.when(p.rlike(r"^\p{L}") & (first(i) | after(i)), upper(p)).otherwise(p))

    return F.array_join(let(cased, capitals), "")


def tidy(text: Column) -> Column:
    """No white space before . , ; : ! ?"""
    return F.regexp_replace(text, r"(?U)\s+([.,;:!?])", "$1")


def denormalised_pair(source: Column, target: Column) -> tuple[Column, Column]:
    """A training pair back in ordinary prose, both cased from the source."""
    return from_model(source, source), from_model(target, source)


def opening_separator(original: Column, answer: Column) -> Column:
    """The answer with the separator that opened the original, unless it begins with one."""
    lead = F.regexp_extract(F.coalesce(original, F.lit("")), r"^[\s:;,|–—-]+", 0)
    mark = F.substring(F.regexp_replace(lead, r"\s", ""), 1, 1)
    return F.when((lead == "") | ((mark != "") & F.ltrim(answer).startswith(mark)), answer).otherwise(F.concat(lead, F.ltrim(answer)))


__all__ = ["casing", "denormalised_pair", "for_model", "from_model", "joined_segments", "opening_separator", "stripped", "tidy", "with_full_stop"]
