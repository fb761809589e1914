"""Queries over conversations and events as run logs: conv_id is the session, turn the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.functions.log_sentences import ABBREVIATIONS, log_sentences
from prosemill.functions.readability import guard_grade
from prosemill.functions.text import review_sentences
from prosemill.operators import audit, guards, runs
from prosemill.plans import sql as q
from prosemill.plans.corpus import turn_pairs
from prosemill.plans.registry import query, table
from prosemill.sources.files import as_json

SKIPS = ["empty-chunk", "bare-url", "under-min-words", "no-letters"]
_SKIP_SQL = f"""CASE WHEN {q.collapsed('line')} = '' THEN 'empty-chunk' WHEN regexp_matches({q.collapsed('line')}, 'https?://') THEN 'bare-url'
 WHEN len({q.words('line')}) < 4 THEN 'under-min-words' WHEN NOT regexp_matches({q.collapsed('line')}, '\\p{{L}}') THEN 'no-letters' END"""
_LINES = "lines AS (SELECT doc_id, lang, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as units."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))


@query(f"""WITH {_LINES}, r AS (SELECT lang, {_SKIP_SQL} AS reason FROM lines)
SELECT lang, count(*) FILTER (reason = 'empty-chunk') AS empty_chunk, count(*) FILTER (reason = 'bare-url') AS bare_url,
 count(*) FILTER (reason = 'under-min-words') AS under_min_words, count(*) FILTER (reason = 'no-letters') AS no_letters FROM r GROUP BY lang""")
def skip_reason_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("lang", runs.unit_skip_reason(F.col("line")).alias("reason"))
    return audit.reason_pivot(rows, "lang", "reason", SKIPS)


_GUARD_STUB = r"regexp_replace(line, '[\t-\r ]*\b[0-9][0-9,.]*\b', '', 'g')"
_TOK = lambda c: q.all_of(f"lower({c})", r"[\p{L}\p{N}_']+")


@query(rf"""WITH {_LINES}, a AS (SELECT lang, line, {_GUARD_STUB} AS answer FROM lines),
t AS (SELECT lang, line, answer, {_TOK('line')} AS x, {_TOK('answer')} AS y, {q.guard_grade('line')} AS gx, {q.guard_grade('answer')} AS gy,
  list_filter({_TOK('line')}, lambda w: NOT regexp_full_match(w, '\p{{Nd}}+')) AS wx, list_filter({_TOK('answer')}, lambda w: NOT regexp_full_match(w, '\p{{Nd}}+')) AS wy FROM a),
r AS (SELECT lang, CASE WHEN len(x) = 0 OR {q.strip('line')} = {q.strip('answer')} THEN NULL
  WHEN x = y AND gx - gy < 0.5 THEN 'no_meaningful_change' WHEN x <> y AND wx = wy AND len(y) < len(x) THEN 'no_meaningful_change' END AS reason FROM t)
SELECT lang, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY ALL""")
def guard_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    reason = guards.change_reason(F.col("line"), runs.stub_answer(F.col("line"), "guard"))
    return rows.select("lang", F.coalesce(reason, F.lit("accepted")).alias("reason")).groupBy("lang", "reason").agg(F.count("*").alias("n"))


_W = lambda c: q.all_of(c, "[A-Za-z']+")
_LOW = lambda c: f"list_transform({_W(c)}, lambda w: lower(w))"
_TURNS = "t AS (SELECT conv_id, turn, text AS source, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS target FROM conversations)"


@query(rf"""WITH {_TURNS}, r AS (SELECT CASE WHEN {q.strip('target')} = '' THEN 'empty' WHEN regexp_matches({q.strip('target')}, '(?i)^\s*complex\s*:') THEN 'prompt_echo'
  WHEN regexp_matches({q.strip('target')}, '(?i)\b(?:i(?:''m| am) sorry|i can(?:''t|not)|i''m unable to|as an ai\b|i do not have the ability)') THEN 'refusal'
  WHEN len({_W('target')}) = 0 THEN 'no_words'
  WHEN len({_W('source')}) > 0 AND len({_W('target')}) > greatest(3.0 * len({_W('source')}), len({_W('source')}) + 12) THEN 'too_long'
  WHEN len({_W('source')}) BETWEEN 1 AND 3 AND NOT list_has_any({_LOW('source')}, {_LOW('target')}) THEN 'unrelated_short_output' ELSE 'accepted' END AS reason FROM t WHERE target IS NOT NULL)
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def prompted_guard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompted guard over turns. The SQL has no back-references and so no degenerate_repetition:
    turns that loop, of which larger tables have some, it counts by the rule they break next, if any."""
    reason = guards.output_reason(F.col("source"), F.col("target"))
    return turn_pairs(spark, sf_dir).select(F.coalesce(reason, F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(rf"""WITH {_TURNS}, r AS (SELECT CASE WHEN len({_W('target')}) > 0 AND len({_W('target')}) < 0.25 * len({_W('source')}) THEN 'too_short'
  WHEN len(list_distinct({_LOW('source')})) BETWEEN 1 AND 3 AND NOT list_has_any({_LOW('source')}, {_LOW('target')}) THEN 'hallucination' ELSE 'neither' END AS kind FROM t WHERE target IS NOT NULL)
SELECT kind, count(*) AS n FROM r GROUP BY kind""")
def retention_and_hallucination(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = F.col("source"), F.col("target")
    kind = F.coalesce(guards.retention_reason(s, t), guards.hallucination_reason(s, t), F.lit("neither"))
    return turn_pairs(spark, sf_dir).select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(rf"""WITH RECURSIVE u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, CAST(ceil(len({q.words('text')}) * 1.6) AS BIGINT) AS n FROM conversations),
f AS (SELECT conv_id, pos, n, n AS t, 0 AS g FROM u WHERE pos = 1 UNION ALL
 SELECT u.conv_id, u.pos, u.n, CASE WHEN f.t > 0 AND f.t + u.n > 64 THEN u.n ELSE f.t + u.n END, f.g + (CASE WHEN f.t > 0 AND f.t + u.n > 64 THEN 1 ELSE 0 END)
 FROM f JOIN u ON u.conv_id = f.conv_id AND u.pos = f.pos + 1)
SELECT conv_id, pos, n AS tokens, CAST(g AS BIGINT) AS group_no FROM f""")
def section_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    units = table(spark, sf_dir, "conversations").withColumn("pos", F.row_number().over(w).cast("long"))
    return runs.pack_units(units, "conv_id", "pos", "text", most=64)


@query("""WITH s AS (SELECT conv_id, max(turn) AS last_flush FROM conversations GROUP BY conv_id ORDER BY last_flush DESC, conv_id DESC LIMIT 20),
r AS (SELECT c.conv_id, c.turn, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC) AS recency FROM conversations c JOIN s USING (conv_id))
SELECT conv_id, turn, recency FROM r WHERE recency <= 3""")
def rolling_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = runs.rolling_retention(table(spark, sf_dir, "conversations"), "conv_id", "turn", "turn", pages=20, each=3)
    return kept.select("conv_id", "turn", F.col("recency").cast("long").alias("recency"))


@query("""WITH o AS (SELECT DISTINCT conv_id AS page, sha256(text) AS cache_key FROM conversations), d AS (SELECT DISTINCT conv_id AS page FROM conversations WHERE role = 'system')
SELECT DISTINCT cache_key FROM o WHERE page IN (SELECT page FROM d) AND cache_key NOT IN (SELECT cache_key FROM o WHERE page NOT IN (SELECT page FROM d))""")
def cache_ownership_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "page")
    own = c.where("text is not null").select("page", F.sha2("text", 256).alias("cache_key")).distinct()
    return runs.evicted_keys(own, c.where("role = 'system'").select("page").distinct())


@query("""WITH k AS (SELECT sha256(text) AS cache_key, min(conv_id * 1000 + turn) AS inserted FROM conversations GROUP BY text)
SELECT cache_key, inserted FROM k ORDER BY inserted DESC LIMIT 128""")
def cache_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "conversations").groupBy(F.sha2("text", 256).alias("cache_key")).agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("inserted"))
    return runs.cache_after_cap(k, "inserted", 128)


@query("""WITH c AS (SELECT sha256(text) AS k, role FROM conversations), cache AS (SELECT DISTINCT k FROM c WHERE role = 'assistant'), r AS (SELECT k FROM c WHERE role <> 'assistant')
SELECT count(*) FILTER (cache.k IS NOT NULL) AS hits, count(DISTINCT r.k) FILTER (cache.k IS NULL) AS distinct_misses FROM r LEFT JOIN cache ON r.k = cache.k""")
def cache_hits_and_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.sha2("text", 256).alias("k"), "role")
    hits, misses = runs.cache_lookup(c.where("role != 'assistant'"), c.where("role = 'assistant'").select("k").distinct(), ["k"])
    one = hits.select(F.lit("hit").alias("x")).unionByName(misses.select(F.lit("miss").alias("x")))
    return one.agg(F.count_if(F.col("x") == "hit").alias("hits"), F.count_if(F.col("x") == "miss").alias("distinct_misses"))


@query("""WITH e AS (SELECT conv_id, turn, text, CASE WHEN length(text) < 40 THEN 'under-min-words' END AS skip_reason, turn % 2 = 0 AS changed, turn % 5 = 0 AS cached FROM conversations)
SELECT conv_id, count(*) AS total, count(*) FILTER (skip_reason IS NOT NULL) AS skipped, count(*) FILTER (skip_reason IS NULL) AS processed,
 count(*) FILTER (skip_reason IS NULL AND changed) AS simplified, count(*) FILTER (skip_reason IS NULL AND NOT changed) AS unchanged, count(*) FILTER (skip_reason IS NULL AND cached) AS cached FROM e GROUP BY conv_id""")
def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "conversations").select(
        "conv_id", F.when(F.length("text") < 40, "under-min-words").alias("skip_reason"), (F.col("turn") % 2 == 0).alias("changed"), (F.col("turn") % 5 == 0).alias("cached")
    )
    return runs.page_stats(e, "conv_id")


@query("""WITH b AS (SELECT conv_id AS session_id, max(turn) AS turns, max(CASE WHEN turn = 2 THEN role END) AS method FROM conversations WHERE role = 'user' OR turn < 2 GROUP BY conv_id),
r AS (SELECT conv_id AS session_id, min(turn) AS turns, max(role) AS method FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT session_id, coalesce(b.turns, r.turns) AS turns, coalesce(b.method, r.method) AS method FROM r FULL JOIN b USING (session_id)""")
def run_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")
    batch = c.where("role = 'user' or turn < 2").groupBy("session_id").agg(F.max("turn").alias("turns"), F.max(F.when(F.col("turn") == 2, F.col("role"))).alias("method"))
    old = c.where("role = 'assistant'").groupBy("session_id").agg(F.min("turn").alias("turns"), F.max("role").alias("method"))
    return runs.upsert_runs(old, batch)


@query("""WITH r AS (SELECT conv_id AS entry, role AS col, text FROM conversations), f AS (SELECT entry FROM r GROUP BY entry HAVING count(DISTINCT col) = 3)
SELECT col, count(*) AS answers, sum(length(text)) AS chars FROM r WHERE entry IN (SELECT entry FROM f) GROUP BY col""")
def all_arms_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("entry"), F.col("role").alias("col"), "text")
    return runs.answered_by_all(r, "entry", "col", 3).groupBy("col").agg(F.count("*").alias("answers"), F.sum(F.length("text")).alias("chars"))


@query("""WITH p AS (SELECT conv_id, role, turn AS part, CASE WHEN turn % 7 <> 3 THEN text END AS output, turn % 2 = 0 AS changed, turn % 3 > 0 AS cached, CASE WHEN turn % 4 = 1 THEN 'r' || turn END AS reason, turn * 10 AS ms,
 count(*) OVER (PARTITION BY conv_id, role) AS expected FROM conversations)
SELECT conv_id, role, CASE WHEN count(output) = max(expected) THEN string_agg(output, ' ' ORDER BY part, output) END AS output, CASE WHEN count(output) = max(expected) THEN bool_or(changed) END AS changed,
 CASE WHEN count(output) = max(expected) THEN bool_and(cached) END AS cached, arg_min(reason, part) FILTER (reason IS NOT NULL) AS reason, CASE WHEN count(output) = max(expected) THEN sum(ms) END AS ms FROM p GROUP BY conv_id, role""")
def multi_part_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    p = table(spark, sf_dir, "conversations").select(
        "conv_id", "role", t.alias("part"), F.when(t % 7 != 3, F.col("text")).alias("output"), (t % 2 == 0).alias("changed"), (t % 3 > 0).alias("cached"),
        F.when(t % 4 == 1, F.concat(F.lit("r"), t.cast("string"))).alias("reason"), (t * 10).alias("ms"), F.count("*").over(Window.partitionBy("conv_id", "role")).alias("expected"),
    )
    return runs.fold_parts(p, "conv_id", "role")


@query("""WITH s AS (SELECT event_type, value FROM events WHERE value IS NOT NULL), n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM s)
SELECT event_type, max(n) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, max(value) FILTER (i = least(n, CAST(floor(0.95 * n) AS BIGINT) + 1)) AS p95, max(value) AS max, min(value) AS min FROM n GROUP BY event_type""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.latency_summary(table(spark, sf_dir, "events"), "value", "event_type")
    return out.withColumn("median", F.round("median", 6)).withColumn("mean", F.round("mean", 6))


_TOKENS = q.all_of("text", "[A-Za-z'']+".replace("''", "'"))
_SY = q.log_syllables(_TOKENS)


@query(rf"""WITH c AS (SELECT source, len({_TOKENS}) AS w, {_SY} AS sy, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS l,
  len(regexp_extract_all(regexp_replace({q.strip('text')}, '([.!?]){q.WS}+', '\1' || chr(1), 'g'), '[^\x01]+')) AS s FROM documents),
t AS (SELECT source, sum(w) AS words, sum(CASE WHEN w = 0 THEN 0 ELSE greatest(s, 1) END) AS sentences, sum(coalesce(list_sum(sy), 0)) AS syllables, sum(len(list_filter(sy, lambda x: x >= 3))) AS polysyllables, sum(l) AS letters FROM c GROUP BY source)
SELECT source, words, sentences, syllables, polysyllables, letters, round(0.39 * words / sentences + 11.8 * syllables / words - 15.59, 6) AS fkgl,
 round(206.835 - 1.015 * words / sentences - 84.6 * syllables / words, 6) AS reading_ease, round(0.4 * (words / sentences + 100 * polysyllables / words), 6) AS fog, round(1.043 * sqrt(polysyllables * 30 / sentences) + 3.1291, 6) AS smog,
 round(0.0588 * letters / words * 100 - 0.296 * sentences / words * 100 - 15.8, 6) AS coleman_liau, round(4.71 * letters / words + 0.5 * words / sentences - 21.43, 6) AS ari FROM t""")
def readability_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.readability(table(spark, sf_dir, "documents"), "text", review_sentences, "source")


_RT = lambda c: q.all_of(f"lower({c})", "[a-z0-9']+")


@query(rf"""WITH {_TURNS}, p AS (SELECT row_number() OVER () AS row, conv_id % 4 AS arm, {_RT('source')} AS a, {_RT('target')} AS b FROM t WHERE target IS NOT NULL),
x AS (SELECT arm, row, unnest(a) AS token, 0 AS side FROM p UNION ALL SELECT arm, row, unnest(b), 1 FROM p), e AS (SELECT arm, row, token, count(*) FILTER (side = 0) AS n, count(*) FILTER (side = 1) AS m FROM x GROUP BY ALL),
s AS (SELECT arm, sum(least(n, m)) AS kept, sum(n) AS n, sum(m) AS m, count(DISTINCT token) FILTER (n > 0) AS tn, count(DISTINCT token) FILTER (m > 0) AS tm FROM e GROUP BY arm)
SELECT arm, kept, m - kept AS added, n - kept AS dropped, round(100.0 * kept / n, 6) AS kept_pct, round(100.0 * (n - kept) / n, 6) AS dropped_pct, round(100.0 * (m - kept) / m, 6) AS added_pct, round(tn / n, 6) AS before_ttr, round(tm / m, 6) AS after_ttr FROM s""")
def rewriting_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.rewriting(turn_pairs(spark, sf_dir).withColumn("arm", F.col("conv_id") % 4), "source", "target", "arm")


@query("""WITH m AS (SELECT event_type AS arm, 'mean' AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1 UNION ALL SELECT event_type, 'largest', max(value) FROM events GROUP BY 1)
SELECT arm, metric, value, value = CASE WHEN metric = 'largest' THEN max(value) OVER (PARTITION BY metric) ELSE min(value) OVER (PARTITION BY metric) END AS best FROM m""")
def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("arm")).agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("largest"))
    long = e.select("arm", F.expr("stack(2, 'mean', mean, 'largest', largest) as (metric, value)"))
    return runs.best_marked(long, ["metric"], "value", F.col("metric") == "largest")


@query(rf"""WITH {_TURNS}, g AS (SELECT conv_id % 4 AS arm, {q.guard_grade('source')} AS a, {q.guard_grade('target')} AS b, {q.collapsed('source')} <> {q.collapsed('target')} AS changed,
 CASE WHEN len({q.words('source')}) > 0 THEN CAST(floor((1 - len({q.words('target')}) / len({q.words('source')})) * 100 + 0.5) AS BIGINT) END AS shorter FROM t WHERE target IS NOT NULL)
SELECT arm, count(*) FILTER (changed) AS changed, round(avg(a) FILTER (changed), 6) AS grade_before, round(avg(b) FILTER (changed), 6) AS grade_after, round(avg(shorter) FILTER (changed), 6) AS pct_shorter FROM g GROUP BY arm""")
def quick_stats_of_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = F.col("source"), F.col("target")
    rows = turn_pairs(spark, sf_dir).select(
        (F.col("conv_id") % 4).alias("arm"), guard_grade(s).alias("a"), guard_grade(t).alias("b"), runs.is_changed(s, t).alias("changed"), runs.percent_shortened(s, t).alias("shorter")
    )
    of = lambda c: F.round(F.avg(F.when(F.col("changed"), F.col(c))), 6)
    return rows.groupBy("arm").agg(F.count_if("changed").alias("changed"), of("a").alias("grade_before"), of("b").alias("grade_after"), of("shorter").alias("pct_shorter"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, max(k) AS sessions, count(*) AS events FROM s GROUP BY user_id""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("""SELECT conv_id AS session_id, CASE WHEN max(turn) > 8 THEN 'failed' WHEN count(*) % 3 = 0 THEN 'stopped' WHEN count(*) FILTER (role = 'system') > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status FROM conversations GROUP BY conv_id""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("t"), F.count("*").alias("n"), F.count_if(F.col("role") == "system").alias("w"))
    return n.select("session_id", runs.run_status(F.col("t") > 8, F.col("n") % 3 == 0, F.col("w")).alias("status"))


@query("""SELECT json_object('conv_id', conv_id, 'turn', turn, 'role', role) AS json FROM conversations""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


_LISTED = ", ".join(f"'{w}'" for w in ABBREVIATIONS)
#: Whether piece p[i] of a text ends a sentence, by its last word and the piece after it.
_ENDS = rf"""i = len(p) OR regexp_matches(mark, '[!?]') OR token = '' OR CASE WHEN regexp_full_match(token, '(?:[A-Za-z]\.)+[A-Za-z]') THEN final
 WHEN regexp_full_match(token, '[A-Za-z]|[0-9]+') THEN false WHEN bare NOT IN ({_LISTED}) THEN true ELSE final END"""


@query(rf"""WITH t AS (SELECT row_number() OVER () AS rn, role, coalesce(text, '') AS text, list_filter(string_split(regexp_replace({q.strip('text')}, '([.!?]+["''’”)\]]?)\s+(["''‘“(\[]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') AS p FROM conversations),
a AS (SELECT rn, p, unnest(range(1, len(p) + 1)) AS i FROM t),
b AS (SELECT *, regexp_extract(p[i], '[.!?]+["''’”)\]]?$') AS mark, regexp_extract(regexp_replace(p[i], '[.!?]+["''’”)\]]?$', ''), '[A-Za-z0-9''’.]+$') AS token FROM a),
e AS (SELECT *, lower(regexp_replace(token, '\.+$', '')) AS bare FROM b), g AS (SELECT *, bare IN ('a.m', 'p.m', 'etc') AND regexp_matches(coalesce(p[i + 1], ''), '^[A-Z]') AS final FROM e),
n AS (SELECT rn, count(*) FILTER ({_ENDS}) AS s FROM g GROUP BY rn),
c AS (SELECT role, len({_TOKENS}) AS w, {_SY} AS sy, len(regexp_extract_all(text, '[A-Za-z]')) AS l, coalesce(s, 0) AS s FROM t LEFT JOIN n USING (rn)),
t2 AS (SELECT role, sum(w) AS words, sum(CASE WHEN w = 0 THEN 0 ELSE greatest(s, 1) END) AS sentences, sum(coalesce(list_sum(sy), 0)) AS syllables, sum(len(list_filter(sy, lambda x: x >= 3))) AS polysyllables, sum(l) AS letters FROM c GROUP BY role)
SELECT role, words, sentences, syllables, polysyllables, letters, round(0.39 * words / sentences + 11.8 * syllables / words - 15.59, 6) AS fkgl,
 round(206.835 - 1.015 * words / sentences - 84.6 * syllables / words, 6) AS reading_ease, round(0.4 * (words / sentences + 100 * polysyllables / words), 6) AS fog, round(1.043 * sqrt(polysyllables * 30 / sentences) + 3.1291, 6) AS smog,
 round(0.0588 * letters / words * 100 - 0.296 * sentences / words * 100 - 15.8, 6) AS coleman_liau, round(4.71 * letters / words + 0.5 * words / sentences - 21.43, 6) AS ari FROM t2""")
def log_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readability of the run log, with the log's own sentence rules."""
    return runs.readability(table(spark, sf_dir, "conversations"), "text", log_sentences, "role")
