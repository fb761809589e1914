"""Golden cases of functions, guards and normalisation."""

import pytest
from pyspark.sql import functions as F

from prosemill.functions import normalise, readability, text
from prosemill.operators import corpus, guards, runs


def one(spark, f, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()
    return row.x


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("The U.S. Army in 1990.", "the u.s. army in 1990 ."),
        ("It cost 28,000 or 3.5, then.", "it cost 28,000 or 3.5 , then ."),
        ('He said "no" twice', "he said `` no '' twice"),
        ('an "open quote', "an `` open quote"),
        ("the dog's tail (long); e.g. this", "the dog 's tail ( long ) ; e.g. this"),
        ("", ""),
    ],
)
def test_for_model(spark, given, want):
    assert one(spark, normalise.for_model, given) == want


@pytest.mark.parametrize(
    ("given", "source", "want"),
    [
        ("the igda is here . it grew .", "About the IGDA. It is.", "The IGDA is here. It grew."),
        ("he said `` no '' ( ) and left .the end", "", 'He said "no" and left. The end'),
        ("the dog 's tail ( long ) , 28,000", "", "The dog's tail (long), 28,000"),
    ],
)
def test_from_model(spark, given, source, want):
    assert one(spark, normalise.from_model, given, source) == want


@pytest.mark.parametrize(
    ("original", "answer", "reason"),
    [
        ("The dog, which was old, sat down slowly.", "The dog which was old sat down slowly.", "no_meaningful_change"),
        ("NBS 15.43 percent of it.", "NBS percent of it.", "no_meaningful_change"),
        ("He came he saw he conquered the whole of the land quickly", "He came. He saw. He conquered the whole of the land quickly", None),
        ("Same text.", "Same text. ", None),
        ("A hard sentence here.", "An easy one.", None),
    ],
)
def test_change_reason(spark, original, answer, reason):
    assert one(spark, guards.change_reason, original, answer) == reason


@pytest.mark.parametrize(
    ("candidate", "reason"),
    [
        ("", "empty"), ("Complex: again", "prompt_echo"), ("I'm sorry, I cannot", "refusal"), ("sat sat sat sat sat", "degenerate_repetition"), ("...", "no_words"),
        ("word " * 40, "degenerate_repetition"), (" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)), "too_long"), ("The cat sat down on the mat.", None),
    ],
)
def test_output_reason(spark, candidate, reason):
    assert one(spark, guards.output_reason, "The cat sat upon the mat.", candidate) == reason


def test_short_and_document_guards(spark):
    assert one(spark, guards.output_reason, "Published", "Other things") == "unrelated_short_output"
    assert one(spark, guards.hallucination_reason, "By", "Other websites") == "hallucination"
    assert one(spark, guards.artifact_reason, "Helpful pages", "Other pages.") == "corpus_artifact"
    assert one(spark, guards.artifact_reason, "Other pages", "Other pages.") is None
    assert one(spark, lambda a, b: guards.output_reason(a, b, document=True), "word one two three four five six seven eight", "one") == "too_short"
    assert one(spark, guards.without_scaffolding, '\nSure! Here\'s a simpler version: "The cat sat ."\nHope it helps') == "The cat sat."


@pytest.mark.parametrize(("given", "want"), [("a b c d e", None), ("", "empty-chunk"), ("see https://x y z w", "bare-url"), ("one two", "under-min-words"), ("1 2 3 4 5", "no-letters")])
def test_unit_skip_reason(spark, given, want):
    assert one(spark, runs.unit_skip_reason, given) == want


def test_sentences_and_counts(spark):
    assert one(spark, text.review_sentences, " One. Two! three? four ") == ["One.", "Two!", "three?", "four"]
    assert one(spark, text.answer_sentences, "It fell.The U.S. Army left. “Go!” he said.") == ["It fell.", "The U.S.", "Army left.", "“Go!”", "he said."]
    assert one(spark, text.serving_sentences, "A b.\nC") == ["A", "b.", "C"]
    assert one(spark, text.ptb_sentences, "the u.s. army left . it won") == 2
    assert one(spark, text.estimated_tokens, "a b c") == 5
    assert [one(spark, readability.guard_syllables, w) for w in ("table", "fire", "tree", "42", "queue")] == [2, 1, 1, 1, 1]
    assert one(spark, text.has_loop, "a b c d e " * 3) and not one(spark, text.has_loop, "a b c d e " * 2)


def test_corpus_predicates(spark):
    assert one(spark, corpus.well_formed, "A fine sentence.") and not one(spark, corpus.well_formed, "Mistakes,.")
    assert one(spark, corpus.retains_meaning, "The cat sat on the mat", "The cat sat") and not one(spark, corpus.retains_meaning, "The cat", "Dogs bark loudly")
    assert one(spark, lambda t: corpus.is_damaged(t, "targeted"), "itâ € ™ s") and not one(spark, lambda t: corpus.is_damaged(t, "targeted"), "château")
    with pytest.raises(ValueError):
        corpus.is_damaged(F.col("x"), "other")
    assert one(spark, normalise.with_full_stop, "history ") == "history." and one(spark, normalise.tidy, "a , b .") == "a, b."
    assert one(spark, normalise.opening_separator, ": he said", "she said") == ": she said"


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Open at approximately 6 a.m. on Tuesdays. Call us.", ["Open at approximately 6 a.m. on Tuesdays.", "Call us."]),
        ("We met at 6 a.m. Collections finish at noon.", ["We met at 6 a.m.", "Collections finish at noon."]),
        ("Dr. Patel and J. Smith saw the U.S. Government.", ["Dr. Patel and J. Smith saw the U.S. Government."]),
        ("6. Put the bins out! Then rest? Yes.", ["6. Put the bins out!", "Then rest?", "Yes."]),
        ("no stop at all", ["no stop at all"]),
        ("", []),
    ],
)
def test_log_sentences(spark, given, want):
    from prosemill.functions.log_sentences import log_sentences

    assert one(spark, log_sentences, given) == want
