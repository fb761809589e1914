"""Queries of reports, audits of snapshots and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.operators import audit, reports
from prosemill.plans import sql as q
from prosemill.plans.corpus import turn_pairs
from prosemill.plans.registry import query, table


@query("""WITH e AS (SELECT DISTINCT conv_id AS entry FROM conversations) SELECT entry, max(CASE WHEN role = 'user' THEN n END) AS user, max(CASE WHEN role = 'assistant' THEN n END) AS assistant, max(CASE WHEN role = 'system' THEN n END) AS system
FROM e LEFT JOIN (SELECT conv_id AS entry, role, count(*) AS n FROM conversations GROUP BY ALL) USING (entry) GROUP BY entry""")
def comparison_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "entry")
    results = c.groupBy("entry", F.col("role").alias("arm")).agg(F.count("*").alias("output"))
    return reports.comparison_cells(c.select("entry").distinct(), results, ["user", "assistant", "system"])


@query("""WITH r AS (SELECT conv_id, max(turn) AS total FROM conversations GROUP BY conv_id), l AS (SELECT conv_id, count(*) AS total FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id AS source_session_id, coalesce(l.total, r.total) AS total FROM r LEFT JOIN l USING (conv_id)""")
def report_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    saved = c.groupBy(F.col("conv_id").alias("source_session_id")).agg(F.max("turn").alias("total"))
    live = c.where("role = 'user'").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("total"))
    return reports.refreshed(saved, live, ["total"])


@query(r"""WITH r AS (SELECT event_type AS page, value, value > 50 AS changed, value > 90 AS cached, CASE WHEN value < 10 THEN 'empty' WHEN value < 20 THEN 'too_long' END AS reason, CAST(floor(value) AS BIGINT) AS words FROM events)
SELECT page, count(*) AS requests, count(*) FILTER (cached) AS from_cache, count(*) FILTER (changed) AS changed, count(*) FILTER (NOT changed) AS unchanged, round(count(*) FILTER (changed) / count(*), 3) AS changed_share,
 count(reason) AS guarded, quantile_cont(words, 0.5) AS words_median, max(words) AS words_max, round(quantile_cont(CASE WHEN changed THEN value / 10 END, 0.5), 6) AS compression_median,
 'empty=' || count(*) FILTER (reason = 'empty') || ',too_long=' || count(*) FILTER (reason = 'too_long') AS guard_reasons FROM r GROUP BY page""")
def site_page_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    r = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("page"), (v > 50).alias("changed"), (v > 90).alias("cached"), F.when(v < 10, "empty").when(v < 20, "too_long").alias("reason"),
        F.floor(v).alias("words"), F.lit(10).alias("chars"), v.alias("out_chars"),
    )
    reasons = F.array_join(F.transform(F.map_entries("guard_reasons"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return audit.page_rollup(r, "page").withColumns({"guard_reasons": reasons, "compression_median": F.round("compression_median", 6)})


@query("""WITH s AS (SELECT lang AS cut, count(*) AS found, count(*) FILTER (n_chars > 1000) AS sent, count(*) FILTER (n_chars > 5000) AS changed FROM documents GROUP BY lang)
SELECT cut, found, sent, changed, CAST(CAST(floor(100 * sent / found + 0.5) AS BIGINT) AS VARCHAR) || '%' AS sent_pct, CAST(CAST(floor(100 * changed / found + 0.5) AS BIGINT) AS VARCHAR) || '%' AS changed_pct FROM s""")
def totals_by_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("cut"), F.lit(1).alias("found"), (F.col("n_chars") > 1000).cast("int").alias("sent"), (F.col("n_chars") > 5000).cast("int").alias("changed"))
    return audit.totals_by(d, "cut", ["found", "sent", "changed"], "found")


@query("""WITH i AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'skipped' ELSE 'sent' END AS status, turn < 6 AS in_scope, turn = 0 AS in_boilerplate, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS words, CASE WHEN turn = 2 THEN 'section-heading' WHEN turn = 4 THEN 'x' END AS reason FROM conversations)
SELECT conv_id, turn FROM i WHERE status = 'skipped' AND in_scope AND NOT in_boilerplate AND words >= 8 AND reason IS DISTINCT FROM 'section-heading'""")
def labelling_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    i = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", "skipped").otherwise("sent").alias("status"), (t < 6).alias("in_scope"), (t == 0).alias("in_boilerplate"),
        F.size(F.filter(F.split("text", " "), lambda w: w != "")).alias("words"), F.when(t == 2, "section-heading").when(t == 4, "x").alias("reason"),
    )
    return audit.labelling_candidates(i).select("conv_id", "turn")


@query(rf"""WITH i AS (SELECT role AS reason, text, conv_id * 1000 + turn AS o FROM conversations), f AS (SELECT reason, text, row_number() OVER (PARTITION BY reason ORDER BY o) AS rank FROM i)
SELECT reason, (SELECT count(*) FROM i WHERE i.reason = f.reason) AS n, string_agg(substring(trim(text), 1, 160), '|' ORDER BY rank) AS samples FROM f WHERE rank <= 5 GROUP BY reason""")
def reason_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "conversations").select(F.col("role").alias("reason"), "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("o"))
    return audit.reason_samples(i, "reason", "text", "o").withColumn("samples", F.array_join("samples", "|"))


@query(f"""WITH t AS (SELECT conv_id, turn, text AS source, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS target FROM conversations),
b AS (SELECT conv_id AS page, turn AS pos, source AS value FROM t WHERE target IS NOT NULL), a AS (SELECT conv_id AS page, turn AS pos, {q.collapsed('source')} AS value FROM t WHERE target IS NOT NULL)
SELECT b.page, b.pos, b.value AS before, a.value AS after FROM b JOIN a USING (page, pos) WHERE b.value IS DISTINCT FROM a.value""")
def snapshot_positional_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosemill.functions.text import collapsed

    rows = turn_pairs(spark, sf_dir).select(F.col("conv_id").alias("page"), F.col("turn").alias("pos"), F.col("source").alias("value"))
    return audit.positional_changes(rows, rows.withColumn("value", collapsed(F.col("value"))))


@query("""WITH c AS (SELECT conv_id, turn, role, text FROM conversations), f AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS t, count(*) AS n FROM c GROUP BY conv_id)
SELECT conv_id, 'whole_sections' AS cut, 1 AS requests, length(t) AS chars FROM f UNION ALL SELECT conv_id, 'sentence_by_sentence', n, length(t) - (n - 1) FROM f""")
def comparison_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = reports.comparison_plan(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return plan.select("conv_id", "cut", F.size("requests").cast("long").alias("requests"), F.aggregate("requests", F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("chars"))


@query("""SELECT event_type AS run, arg_min(event_id, (value, event_id)) AS checkpoint, min(value) AS loss FROM events GROUP BY event_type""")
def best_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.best_checkpoint(table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("checkpoint"), F.col("value").alias("loss")))


@query("""SELECT 'has_text' AS check, count(*) FILTER (NOT coalesce(length(text) > 0, false)) AS failures, true AS blocking, count(*) FILTER (NOT coalesce(length(text) > 0, false)) = 0 AS passed FROM documents
UNION ALL SELECT 'counts_characters', count(*) FILTER (NOT coalesce(length(text) = n_chars, false)), false, count(*) FILTER (NOT coalesce(length(text) = n_chars, false)) = 0 FROM documents
UNION ALL SELECT 'short', count(*) FILTER (NOT coalesce(n_chars < 10000, false)), false, count(*) FILTER (NOT coalesce(n_chars < 10000, false)) = 0 FROM documents""")
def preflight_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return reports.preflight(table(spark, sf_dir, "documents"), {"has_text": (n > 0, True), "counts_characters": (n == F.col("n_chars"), False), "short": (F.col("n_chars") < 10_000, False)})


@query("""SELECT conv_id, turn, 'Rewrite it.' || chr(10) || chr(10) || 'Complex: a hard one' || chr(10) || 'Simple: an easy one' || chr(10) || chr(10) || 'Complex: ' || text || chr(10) || 'Simple:' AS prompt FROM conversations""")
def sentence_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array(F.struct(F.lit("a hard one").alias("complex"), F.lit("an easy one").alias("simple")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", reports.sentence_prompt(F.lit("Rewrite it."), shown, F.col("text")).alias("prompt"))


@query("""SELECT role, CASE WHEN role = 'user' THEN 'reader' WHEN role = 'assistant' THEN 'model' ELSE role END AS label, CASE WHEN role = 'user' THEN 'assistant' WHEN role IN ('assistant') THEN role ELSE 'assistant' END AS stored, count(*) AS n FROM conversations GROUP BY role""")
def vocabulary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"))
    out = reports.labelled(n, "role", {"user": "reader", "assistant": "model"}, "label")
    return out.withColumn("stored", reports.migrated(F.col("role"), {"user": "assistant"}, ["assistant"], "assistant"))
