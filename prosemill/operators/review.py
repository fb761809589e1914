"""Qualitative rollups over (idx, source, reference, prediction) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions.text import has_loop, let, numbers, review_sentences, review_tokens, stripped, years
from prosemill.operators.corpus import DISAMBIGUATION

BUCKETS = ((0, 60), (60, 120), (120, 250), (250, None))


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def _words(c: str) -> Column:
    return F.size(review_tokens(F.col(c)))


def describe_system(rows: DataFrame, *by: str) -> DataFrame:
    """Medians and counts of how predictions differ from sources and references."""
    p, s = F.col("prediction"), F.col("source")
    pw, ps = F.size("p_words"), F.size(review_sentences(p))
    sw, ss = F.size("s_words"), F.size(review_sentences(s))
    inside = let(F.col("s_words"), lambda s: F.size(F.filter("p_words", lambda t: F.array_contains(s, t))))
    new = lambda f: F.size(F.array_except(f(p), f(s))) > 0
    rows = rows.withColumn("p_words", review_tokens(p)).withColumn("s_words", review_tokens(s)).select(
        *by,
        _ratio(pw, sw).alias("length_ratio"),
        _ratio(ps, ss).alias("sentence_ratio"),
        _ratio(pw, ps).alias("words_per_sentence"),
        (stripped(p) == stripped(s)).alias("identical"),
        ((pw > 0) & (inside / pw > 0.98) & (_ratio(pw, sw) > 0.9)).alias("near_copy"),
        (ps > ss).alias("split"),
        (pw < 0.5 * _words("reference")).alias("under_half"),
        new(years).alias("new_year"),
        new(numbers).alias("new_number"),
        has_loop(p).alias("loop"),
        (stripped(p) == "").alias("empty"),
    )
    median = lambda c, d: F.round(F.percentile(c, F.lit(0.5)), d).alias(f"{c}_median")
    flags = ("identical", "near_copy", "split", "under_half", "new_year", "new_number", "loop", "empty")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), median("length_ratio", 3), median("sentence_ratio", 3), median("words_per_sentence", 2),
        *[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags],
    )


def length_buckets(rows: DataFrame) -> DataFrame:
    """By source words: rows and median length ratios of predictions and references."""
    n = F.col("n")
    label = F.lit(None).cast("string")
    for low, high in reversed(BUCKETS):
        label = F.when(n >= low, f"{low}-{high or '+'}").otherwise(label) if high is None else F.when((n >= low) & (n < high), f"{low}-{high}").otherwise(label)
    rows = rows.select(_words("source").alias("n"), _words("prediction").alias("p"), _words("reference").alias("r"))
    median = lambda c: F.round(F.percentile(_ratio(F.col(c), n), F.lit(0.5)), 3)
    return rows.withColumn("source_words", label).groupBy("source_words").agg(
        F.count("*").alias("rows"), median("p").alias("prediction_ratio"), median("r").alias("reference_ratio")
    )


def phrase_probe(rows: DataFrame, kept: str, lost: str) -> DataFrame:
    """Of sources with phrase ``kept``: what predictions and references say of it and of ``lost``."""
    says = lambda c, p: F.col(c).contains(p)
    return rows.where(says("source", kept)).agg(
        F.count("*").alias("sources"),
        F.count_if(says("prediction", lost)).alias("says_lost"),
        F.count_if(says("prediction", kept)).alias("keeps"),
        F.count_if(says("prediction", lost) & ~says("prediction", kept)).alias("lost_only"),
        F.count_if(~says("prediction", lost) & ~says("prediction", kept)).alias("neither"),
        F.count_if(says("reference", kept)).alias("references_keep"),
        F.count_if(says("reference", lost)).alias("references_say_lost"),
    )


def pairing_probe(rows: DataFrame, pattern: str = DISAMBIGUATION) -> DataFrame:
    """Sources that only list meanings, and those of them whose reference is a whole article."""
    stub = stripped(F.col("source")).rlike(pattern)
    s, r = _words("source"), _words("reference")
    grown = stub & (r >= 20) & (r >= 3 * F.greatest(s, F.lit(1)))
    share = lambda n: F.bround(100.0 * n / F.greatest(F.count("*"), F.lit(1)), 2)
    return rows.agg(
        F.count_if(stub).alias("stubs"), share(F.count_if(stub)).alias("stub_pct"),
        F.count_if(grown).alias("expansions"), share(F.count_if(grown)).alias("expansion_pct"),
        F.percentile(F.when(grown, s), F.lit(0.5)).alias("median_source_words"), F.percentile(F.when(grown, r), F.lit(0.5)).alias("median_reference_words"),
    )


def collect_examples(rows: DataFrame, k: int) -> DataFrame:
    """The first k rows of each category by idx: category, rank, idx."""
    p, s = F.col("prediction"), F.col("source")
    sw, pw = review_tokens(s), review_tokens(p)
    content = F.filter(pw, lambda t: F.length(t) > 3)
    novel = let(sw, lambda known: F.size(F.filter(content, lambda t: ~F.array_contains(known, t)))) / F.size(content) > 0.4
    cases = {
        "introduced_year": F.size(F.array_except(years(p), years(s))) > 0,
        "returned_source_unchanged": stripped(s) == stripped(p),
        "compressed_far_below_reference": (F.size(pw) < 0.5 * _words("reference")) & (F.size(sw) > 150),
        "novel_content": (F.size(content) > 0) & novel,
    }
    hit = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k_)) for k_, c in cases.items()]), lambda x: x.isNotNull())
    order = Window.partitionBy("category").orderBy("idx")
    return rows.select("idx", F.explode(hit).alias("category")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def corpus_shape(rows: DataFrame) -> DataFrame:
    """Words, sentences and words a sentence of sources and references."""
    sides = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("t")) for c in ("source", "reference")])).alias("x"))
    w, s = F.size(review_tokens(F.col("x.t"))), F.size(review_sentences(F.col("x.t")))
    return sides.select("x.side", w.alias("w"), s.alias("s"), _ratio(w, s).alias("ws")).groupBy("side").agg(
        F.percentile("w", F.lit(0.5)).alias("words_median"), F.bround(F.avg("w"), 1).alias("words_mean"),
        F.percentile("s", F.lit(0.5)).alias("sentences_median"), F.round(F.percentile("ws", F.lit(0.5)), 2).alias("words_per_sentence_median"),
    )
