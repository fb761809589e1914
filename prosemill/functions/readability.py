"""Syllables and readability formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosemill.functions.text import change_tokens, ending_marks, letter_tokens

def guard_syllables(word: Column) -> Column:
    """Vowel groups less a silent e (not -le, -ee), at least 1; a number counts 1."""
    groups = F.regexp_count(word, F.lit("[aeiouy]+"))
    silent = word.endswith("e") & ~word.endswith("le") & ~word.endswith("ee") & (groups > 1)
    return F.when(word.rlike(r"^\p{Nd}+$"), 1).otherwise(F.greatest(groups - silent.cast("int"), F.lit(1)))


def log_syllables(word: Column) -> Column:
    """As the run log counts: letters a-z only, any final e is silent; 0 without letters."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent = w.endswith("e") & (groups > 1)
    return F.when(w == "", 0).otherwise(F.greatest(groups - silent.cast("int"), F.lit(1)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def guard_grade(text: Column) -> Column:
    """Flesch-Kincaid grade over change tokens; 0 without any."""
    tokens = change_tokens(text)
    n = F.size(tokens)
    syllables = _total(F.transform(tokens, guard_syllables))
    return F.when(n == 0, F.lit(0.0)).otherwise(0.39 * (n / ending_marks(text)) + 11.8 * (syllables / n) - 15.59)


def counts(text: Column, sentences: Column) -> dict[str, Column]:
    """What the corpus formulas sum: words, sentences (0 without words), syllables, words of three
    syllables or more, letters."""
    tokens = letter_tokens(text)
    each = F.transform(tokens, log_syllables)
    return {
        "words": F.size(tokens).cast("long"),
        "sentences": F.when(F.size(tokens) == 0, 0).otherwise(F.greatest(sentences, F.lit(1))).cast("long"),
        "syllables": _total(each).cast("long"),
        "polysyllables": F.size(F.filter(each, lambda x: x >= 3)).cast("long"),
        "letters": F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]")).cast("long"),
    }


def formulas(w: Column, s: Column, y: Column, p: Column, letters: Column) -> dict[str, Column]:
    """Readability of summed counts; null without words or sentences."""
    ok = (w > 0) & (s > 0)
    return {
        k: F.when(ok, v)
        for k, v in {
            "fkgl": 0.39 * w / s + 11.8 * y / w - 15.59,
            "reading_ease": 206.835 - 1.015 * w / s - 84.6 * y / w,
            "fog": 0.4 * (w / s + 100 * p / w),
            "smog": 1.043 * F.sqrt(p * 30 / s) + 3.1291,
            "coleman_liau": 0.0588 * letters / w * 100 - 0.296 * s / w * 100 - 15.8,
            "ari": 4.71 * letters / w + 0.5 * w / s - 21.43,
        }.items()
    }
