"""Output guards: a reason code for an answer that should not be served, null for one that may."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions.normalise import tidy
from prosemill.functions.readability import guard_grade
from prosemill.functions.text import change_tokens, letter_tokens, stripped

# fixed values: limits and patterns of the guards
MIN_GRADE_GAIN = 0.5
LENGTH_RATIO, HEADROOM, RETENTION, SHORT_INPUT = 3.0, 12, 0.25, 3
SENTENCE_ECHO = r"(?i)^\s*complex\s*:"
DOCUMENT_ECHO = r"(?i)^\s*(?:text|simplified\s+text)\s*:"
REFUSAL = r"(?i)\b(?:i(?:'m| am) sorry|i can(?:'t|not)|i'm unable to|as an ai\b|i do not have the ability)"
LOOP = r"(?i)\b(\w+)\b(?:[\s,;:.]+\b\1\b){3,}"
ARTIFACTS = ("other websites", "other pages")
PREFIX = (
    r"(?i)^\s*(?:(?:sure|certainly|of\s+course|okay|ok)\s*[,!.]?\s*"
    r"|here(?:'s|\s+is)\s+(?:the\s+|a\s+)?(?:simplified|simpler|rewritten)\s+(?:version|sentence|text)\s*[:\-]?\s*"
    r"|(?:simplified|simpler|rewritten)\s+(?:version|sentence|text)\s*[:\-]\s*|simple\s*:\s*)+"
)
BULLET = r"(?m)^\s*(?:[-*•]|\d+[.)])[^\S\n]+"
SENTENCE_STOPS = ("\nComplex:", "\nSimple:", "\n\n")
DOCUMENT_STOPS = ("\nText:", "\nSimplified text:")
REASONS = (
    "hallucination", "empty", "prompt_echo", "refusal", "degenerate_repetition", "no_words", "too_long", "too_short",
    "unrelated_short_output", "timeout", "error", "corpus_artifact", "no_meaningful_change",
)


def _first(*rules: tuple[str, Column]) -> Column:
    out = None
    for reason, rule in rules:
        out = F.when(rule, reason) if out is None else out.when(rule, reason)
    return out


def change_reason(original: Column, answer: Column) -> Column:
    """no_meaningful_change for edits of punctuation only that gain too little, and for answers that
    only lose numbers; identical answers are no rejection."""
    a, b = change_tokens(original), change_tokens(answer)
    words = lambda t: F.filter(t, lambda w: ~w.rlike(r"^\p{Nd}+$"))
    accepted = (F.size(a) == 0) | (stripped(original) == stripped(answer))
    cosmetic = (a == b) & (guard_grade(original) - guard_grade(answer) < MIN_GRADE_GAIN)
    lost = (a != b) & (words(a) == words(b)) & (F.size(b) < F.size(a))
    return F.when(~accepted & (cosmetic | lost), "no_meaningful_change")


def _too_short(n: Column, m: Column) -> Column:
    return (n > 0) & (m < n * F.lit(RETENTION))


def output_reason(original: Column, candidate: Column, document: bool = False) -> Column:
    """The first rule that a prompted model's answer breaks."""
    text = stripped(candidate)
    a, b = letter_tokens(original), letter_tokens(text)
    n, m = F.size(a), F.size(b)
    some = n > 0
    lower = lambda t: F.transform(t, F.lower)
    rules = [
        ("empty", text == ""),
        ("prompt_echo", text.rlike(DOCUMENT_ECHO if document else SENTENCE_ECHO)),
        ("refusal", text.rlike(REFUSAL)),
        ("degenerate_repetition", text.rlike(LOOP)),
        ("no_words", m == 0),
        ("too_long", some & (m > F.greatest(n * F.lit(LENGTH_RATIO), (n + HEADROOM).cast("double")))),
    ]
    if document:
        rules.append(("too_short", _too_short(n, m)))
    else:
        rules.append(("unrelated_short_output", some & (n <= SHORT_INPUT) & ~F.arrays_overlap(lower(a), lower(b))))
    return _first(*rules)


def retention_reason(original: Column, answer: Column) -> Column:
    """too_short for answers with words, but too few of them, whatever other rules they break."""
    n, m = F.size(letter_tokens(original)), F.size(letter_tokens(answer))
    return F.when((m > 0) & _too_short(n, m), "too_short")


def hallucination_reason(original: Column, answer: Column) -> Column:
    """hallucination for one to three different input words of which the answer has none."""
    a = F.array_distinct(F.transform(letter_tokens(original), F.lower))
    b = F.transform(letter_tokens(answer), F.lower)
    return F.when(F.size(a).between(1, SHORT_INPUT) & ~F.arrays_overlap(a, b), "hallucination")


def artifact_reason(original: Column, answer: Column) -> Column:
    whole = lambda t: F.array_join(F.transform(letter_tokens(t), F.lower), " ")
    return F.when(whole(answer).isin(*ARTIFACTS) & ~whole(original).isin(*ARTIFACTS), "corpus_artifact")


def without_scaffolding(raw: Column, document: bool = False) -> Column:
    """A raw completion cut down to the answer: stop sequences, preambles, quotes and bullets go."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+", "")
    at = lambda stop: F.nullif(F.locate(stop, text), F.lit(0))
    cut = F.least(*[at(s) for s in (DOCUMENT_STOPS if document else SENTENCE_STOPS)])
    text = F.when(cut.isNotNull(), text.substr(F.lit(1), cut - 1)).otherwise(text)
    text = F.regexp_replace(text, PREFIX, "")
    if document:
        text = stripped(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?m)[^\S\n]+$", ""), BULLET, ""), r"\n{3,}", "\n\n"))
    else:
        text = F.coalesce(F.get(F.filter(F.transform(F.split(text, r"\R"), stripped), lambda x: x != ""), F.lit(0)), F.lit(""))
    text = stripped(F.regexp_replace(text, PREFIX, ""))
    quoted = text.rlike("(?s)^[\"'“‘].*[\"'”’]$") & (F.length(text) >= 2)
    return tidy(F.when(quoted, stripped(text.substr(F.lit(2), F.length(text) - 2))).otherwise(text))


def guarded(answers: DataFrame, original: str = "original", answer: str = "answer", model: str = "sequence", document: bool = False) -> DataFrame:
    """answers with model_result, reason and served: the model's own guard, then the artifact guard,
    then the change guard; the first reason counts and the original is served then.

    ``model`` is "sequence" (a fine-tuned model) or "prompted" (raw completions).
    """
    o, a = F.col(original), F.col(answer)
    if model == "prompted":
        a = without_scaffolding(a, document)
        own = output_reason(o, F.col("model_result"), document)
    elif document:
        own = F.when(stripped(F.col("model_result")) == "", "empty")
    else:
        own = hallucination_reason(o, F.col("model_result"))
    m = F.col("model_result")
    reason = F.coalesce(own, artifact_reason(o, m), change_reason(o, m))
    return answers.withColumn("model_result", a).withColumn("reason", reason).withColumn("served", F.when(F.col("reason").isNull(), m).otherwise(o))
