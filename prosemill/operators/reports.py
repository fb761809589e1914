"""Reports and configuration as data: snapshots, comparisons, replays, prompts, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions.text import collapsed, let
from prosemill.operators.runs import unit_skip_reason, word_count

# fixed values: vocabularies that stored records use
AUDIENCES = ("non_native_speakers", "children", "low_literacy", "cognitive_disability", "general_adult")
RENAMED_MODELS = {"llm": "llm_7b", "local": "finetuned"}
RENAMED_GRANULARITIES = {"sentence": "sentence_by_sentence", "document": "whole_sections"}
COVERAGE_WORDS = 12
NEGATIONS = ("not", "no", "never", "none", "nor", "neither", "without", "cannot")


def refreshed(reports: DataFrame, runs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Saved reports with the fields of the live run where it still exists, else the snapshot's."""
    live = runs.select(F.col("session_id").alias("source_session_id"), *[F.col(f).alias(f"_{f}") for f in fields])
    out = reports.join(live, "source_session_id", "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else c for c in reports.columns])


def comparison_cells(entries: DataFrame, results: DataFrame, arms: Sequence[str]) -> DataFrame:
    """One row per entry and one column per arm: its output, null where it gave none."""
    wide = results.groupBy("entry").pivot("arm", list(arms)).agg(F.first("output"))
    return entries.join(wide, "entry", "left")


def replayed(entries: DataFrame, answers: DataFrame, default_audience: str = "general_adult") -> DataFrame:
    """Logged inputs next to another model's answers on the same audience; an input without an
    answer is a failed row, not an abort."""
    keyed = entries.withColumn("audience", F.coalesce("audience", F.lit(default_audience)))
    out = keyed.join(answers.select("audience", F.col("text").alias("input"), F.col("answer").alias("replayed")), ["audience", "input"], "left")
    return out.withColumn("failed", F.col("replayed").isNull())


def labelled(rows: DataFrame, key: str, names: Mapping[str, str], to: str) -> DataFrame:
    """A small vocabulary's labels, the raw key where it has none."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return rows.withColumn(to, F.coalesce(F.try_element_at(known, F.col(key)), F.col(key)))


def migrated(stored: Column, renamed: Mapping[str, str], known: Sequence[str], default: str) -> Column:
    """A stored key under its present name; unknown and missing ones are the default."""
    names = F.create_map(*[F.lit(x) for kv in renamed.items() for x in kv])
    now = F.coalesce(F.try_element_at(names, stored), stored)
    return F.when(now.isin(*known, *renamed.values()), now).otherwise(default)


def first_present(*values: Column) -> Column:
    return F.coalesce(*values)


def run_progress(processed: Column, skipped: Column, total: Column) -> Column:
    """done and whether the run is over; without a total it is still running."""
    done = processed + skipped
    return F.struct(done.alias("done"), F.when(total.isNull(), "running").when(done >= total, "done").otherwise("running").alias("state"))


def comparison_progress(done: Column, runs: Column, units: Column) -> Column:
    return F.least(done, runs * units)


def worth_recording(batches: DataFrame, session: str, order: str) -> DataFrame:
    """Batches with ``record``: empty ones aren't recorded, a session's first is, later ones if
    anything in them wasn't cached (entries array of structs with cached)."""
    some = F.size("entries") > 0
    seen = F.coalesce(F.max(some.cast("int")).over(Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.exists("entries", lambda e: ~e["cached"])
    return batches.withColumn("record", some & ((seen == 0) | fresh))


def late_prose(elements: DataFrame, body: Sequence[str]) -> DataFrame:
    """Elements that came late, hold prose and were not rewritten."""
    return elements.where(F.col("tag").isin(*body) & ~F.col("rewritten") & ~F.col("opted_out") & (word_count(F.col("text")) >= COVERAGE_WORDS))


def placeholder_reason(text: Column, opted_out: Column, done: Column) -> Column:
    """A placeholder's skip reason: as units', prefixed; null if it is sent."""
    own = F.when(done, "already-simplified").when(opted_out, "opted-out").when(collapsed(text) == "", "placeholder-empty")
    return F.concat(F.lit("placeholder:"), F.coalesce(own, unit_skip_reason(text)))


def sentence_prompt(instruction: Column, examples: Column, text: Column) -> Column:
    """Instruction, demonstrations (array of structs complex, simple) and the open last pair."""
    shown = F.transform(examples, lambda e: F.concat(F.lit("Complex: "), e["complex"], F.lit("\nSimple: "), e["simple"]))
    return F.concat_ws("\n\n", F.concat(F.array(instruction), shown, F.array(F.concat(F.lit("Complex: "), text, F.lit("\nSimple:")))))


def document_prompt(instruction: Column, text: Column) -> Column:
    return F.concat_ws("\n\n", instruction, F.concat(F.lit("Text: "), text, F.lit("\nSimplified text:")))


def document_budget(context: Column, predict: Column, longest: Column) -> Column:
    """Tokens a document may have: what a prompted model's context leaves, at least 256; a
    fine-tuned model's longest input; null for sentence models."""
    return F.when(context.isNotNull(), F.greatest(F.lit(256), context - predict - 200)).otherwise(longest)


def cache_name(model: Column, decoding: Column, seed: Column, sampled: Column) -> Column:
    """Provenance in a name: decoding for deterministic models, the seed only for sampled ones."""
    return F.concat_ws("-", model, F.when(sampled, F.concat(F.lit("seed"), seed.cast("string"))).otherwise(decoding))


def best_checkpoint(losses: DataFrame) -> DataFrame:
    """The checkpoint of least loss per run."""
    return losses.groupBy("run").agg(F.min_by("checkpoint", F.struct("loss", "checkpoint")).alias("checkpoint"), F.min("loss").alias("loss"))


def dropped_negation(before: Column, after: Column) -> Column:
    """Whether the answer is the input less exactly one negation."""
    split = lambda c: F.split(F.lower(collapsed(c)), " ")

    def dropped(both: Column) -> Column:
        a, b = both["a"], both["b"]
        at = F.filter(F.transform(a, lambda w, i: F.when(w.isin(*NEGATIONS), i + 1)), lambda i: i.isNotNull())
        cut = lambda i: F.concat(F.slice(a, F.lit(1), i - 1), F.slice(a, i + 1, F.size(a)))
        return (F.size(a) == F.size(b) + 1) & F.exists(at, lambda i: cut(i) == b)

    return let(F.struct(split(before).alias("a"), split(after).alias("b")), dropped)


def comparison_plan(units: DataFrame, section: str, order: str) -> DataFrame:
    """Requests of each cut for the units of sections: whole sections are one request, sentence by
    sentence is one each; entries are the sections, in order."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "text")))
    rows = units.groupBy(section).agg(F.transform(ordered, lambda x: x["text"]).alias("t"))
    cuts = F.create_map(F.lit("whole_sections"), F.array(F.array_join("t", " ")), F.lit("sentence_by_sentence"), F.col("t"))
    return rows.select(section, F.explode(cuts).alias("cut", "requests"))


def preflight(rows: DataFrame, checks: Mapping[str, tuple[Column, bool]]) -> DataFrame:
    """Checks over rows in one pass: name, failures, whether it blocks, and whether it passed."""
    counts = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, (ok, _) in checks.items()])
    each = [F.struct(F.lit(n).alias("check"), F.col(n).alias("failures"), F.lit(b).alias("blocking"), (F.col(n) == 0).alias("passed")) for n, (_, b) in checks.items()]
    return counts.select(F.explode(F.array(*each)).alias("x")).select("x.*")
