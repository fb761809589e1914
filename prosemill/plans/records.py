"""Queries over records of runs, corpora and settings: conv_id is the session, turn the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.functions.dates import compact_stamp, epoch_ms, iso_utc
from prosemill.functions.normalise import for_model, from_model, joined_segments
from prosemill.functions.text import review_sentences, sha16
from prosemill.operators import audit, metrics, reports, runs
from prosemill.operators import corpus as op
from prosemill.plans import sql as q
from prosemill.plans.corpus import turn_pairs
from prosemill.plans.registry import query, table

_POS = "row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)"
_PAIRS = "p AS (SELECT * FROM (SELECT conv_id, turn, text AS source, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS target FROM conversations) WHERE target IS NOT NULL)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf_dir, "conversations").withColumn("pos", F.row_number().over(w).cast("long"))


@query(f"""SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant') AND turn % 3 <> 0 AND turn <> 1 AND len({q.words('text')}) >= 12""")
def late_prose_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    e = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("role").alias("tag"), "text", (t % 3 == 0).alias("rewritten"), (t == 1).alias("opted_out"))
    return reports.late_prose(e, ("user", "assistant")).select("conv_id", "turn", "role")


@query(f"""WITH b AS (SELECT conv_id, {_POS} AS pos, role FROM conversations)
SELECT conv_id, pos, role <> 'system' AND (coalesce(max((role <> 'system')::INT) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 OR role = 'user') AS record FROM b""")
def recorded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System turns stand for empty batches, assistants' for cached ones."""
    none = F.array().cast("array<struct<cached:boolean>>")
    entries = F.when(F.col("role") == "system", none).otherwise(F.array(F.struct((F.col("role") == "assistant").alias("cached"))))
    return reports.worth_recording(_turns(spark, sf_dir).withColumn("entries", entries), "conv_id", "pos").select("conv_id", "pos", "record")


@query("""WITH a AS (SELECT DISTINCT text AS input, CASE WHEN turn % 2 = 0 THEN 'children' ELSE 'general_adult' END AS audience FROM conversations WHERE role = 'user' AND turn % 4 < 2)
SELECT conv_id, turn, c.audience, reverse(a.input) AS replayed, a.input IS NULL AS failed
FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN 'children' ELSE 'general_adult' END AS audience FROM conversations WHERE role = 'user') c LEFT JOIN a ON a.input = c.text AND a.audience = c.audience""")
def replayed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another model has answers for half of the users' turns only."""
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    entries = users.select("conv_id", "turn", F.col("text").alias("input"), F.when(F.col("turn") % 2 == 0, "children").alias("audience"))
    answers = users.where("turn % 4 < 2").select(F.when(F.col("turn") % 2 == 0, "children").otherwise("general_adult").alias("audience"), "text", F.reverse("text").alias("answer")).distinct()
    return reports.replayed(entries, answers).select("conv_id", "turn", "audience", "replayed", "failed")


@query("""WITH r AS (SELECT conv_id, count(*) FILTER (role <> 'system') AS p, count(*) FILTER (role = 'system') AS s, CASE WHEN conv_id % 5 > 0 THEN max(turn) END AS total FROM conversations GROUP BY conv_id)
SELECT conv_id, p + s AS done, CASE WHEN total IS NULL THEN 'running' WHEN p + s >= total THEN 'done' ELSE 'running' END AS state, least(p + s, 2 * 3) AS compared FROM r""")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    system = F.col("role") == "system"
    r = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count_if(~system).alias("p"), F.count_if(system).alias("s"), F.when(F.col("conv_id") % 5 > 0, F.max("turn")).alias("total")
    )
    progress = reports.run_progress(F.col("p"), F.col("s"), F.col("total"))
    return r.select("conv_id", progress["done"].alias("done"), progress["state"].alias("state"), reports.comparison_progress(progress["done"], F.lit(2), F.lit(3)).alias("compared"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN greatest(256, n_chars - 100 - 200) WHEN doc_id % 3 = 1 THEN 1024 END AS budget,
 lang || '-' || CASE WHEN doc_id % 2 = 0 THEN 'seed' || (doc_id % 7) ELSE source END AS cache FROM documents""")
def document_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token budgets and cache names; lengths stand in for context sizes."""
    i = F.col("doc_id")
    budget = reports.document_budget(F.when(i % 3 == 0, F.col("n_chars")), F.lit(100), F.when(i % 3 == 1, F.lit(1024).cast("long")))
    return table(spark, sf_dir, "documents").select("doc_id", budget.alias("budget"), reports.cache_name(F.col("lang"), F.col("source"), i % 7, i % 2 == 0).alias("cache"))


@query(f"""WITH d AS (SELECT doc_id, {q.words("lower(text || CASE WHEN doc_id % 2 = 0 THEN ' never it' ELSE ' ever it' END)")} AS a, {q.words("lower(text || ' it')")} AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(a) = len(b) + 1 AND len(list_filter(list_filter(range(1, len(a) + 1), lambda i: a[i] IN ('not', 'no', 'never', 'none', 'nor', 'neither', 'without', 'cannot')), lambda i: list_concat(a[1:i-1], a[i+1:]) = b)) > 0 AS dropped FROM d""")
def dropped_negations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other text ends in a negation that its rewriting lacks."""
    t = F.col("text")
    end = F.when(F.col("doc_id") % 2 == 0, " never it").otherwise(" ever it")
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", reports.dropped_negation(F.concat(t, end), F.concat(t, F.lit(" it"))).alias("dropped"))


@query(rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{q.WS}+$', '')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, substring(sha256(array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '[.?!]$') THEN x ELSE x || '.' END), ' ')), 1, 16) AS joined FROM l""")
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sha16(joined_segments(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("joined"))


_BARE = r"regexp_replace({}, '\s(?:class|title|data-simplified)=\"[^\"]*\"', '', 'g')"
_TEXT = r"trim(regexp_replace(regexp_replace({}, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))"
_AFTER = "CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN replace(html, '<article>', '<article class=\"x\">') ELSE replace(html, 'the ', 'a ') END"


@query(f"""WITH p AS (SELECT page_id, html AS b, {_AFTER} AS a FROM pages WHERE html IS NOT NULL)
SELECT page_id, b = a AS identical, {_BARE.format('b')} = {_BARE.format('a')} AS identical_bare, {_TEXT.format('b')} = {_TEXT.format('a')} AS identical_text FROM p""")
def revert_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the pages came back as they were, a third with an attribute more."""
    h, i = F.col("html"), F.col("page_id") % 3
    after = F.when(i == 0, h).when(i == 1, F.replace(h, F.lit("<article>"), F.lit('<article class="x">'))).otherwise(F.replace(h, F.lit("the "), F.lit("a ")))
    checks = audit.revert_equality(h, after)
    return table(spark, sf_dir, "pages").where("html is not null").select("page_id", *[c.alias(k) for k, c in checks.items()])


_ANCHORS = """a AS (SELECT page_id AS page, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS label, unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)))) AS pos, html FROM pages)"""


@query(f"""WITH {_ANCHORS} SELECT page, pos, label, CASE WHEN pos % 5 = 4 THEN 'orphaned' WHEN page % 2 = 0 AND contains(html, label) THEN 'misplaced' ELSE 'deleted' END AS kind
FROM a WHERE label <> '' AND (pos % 5 = 4 OR pos % 3 = 0)""")
def lost_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third link lost its label, every fifth is gone; odd pages lost their text too."""
    pages = table(spark, sf_dir, "pages")
    labels = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    before = pages.select(F.col("page_id").alias("page"), F.posexplode(labels).alias("pos", "label"))
    after = before.where("pos % 5 != 4").withColumn("label", F.when(F.col("pos") % 3 != 0, F.col("label")).otherwise(""))
    text = pages.select(F.col("page_id").alias("page"), F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise("").alias("text"))
    return audit.lost_anchors(before, after, text).select("page", F.col("pos").cast("long").alias("pos"), "label", "kind")


@query(f"""WITH {_ANCHORS} SELECT page, pos, CASE WHEN pos % 2 = 0 THEN 'href=' || label ELSE '' END AS lost, 'title=' || pos AS gained FROM a WHERE pos % 4 < 3""")
def changed_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links before and after a rewriting that adds titles and loses every other address."""
    labels = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    a = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.posexplode(labels).alias("pos", "label"))
    href, title, rel = F.concat(F.lit("href="), "label"), F.concat(F.lit("title="), F.col("pos").cast("string")), F.lit("rel=x")
    before = a.select("page", "pos", F.array(href, rel).alias("attrs"))
    now = F.when(F.col("pos") % 4 == 3, F.array(href, rel)).when(F.col("pos") % 2 == 0, F.array(rel, title)).otherwise(F.array(href, rel, title))
    out = audit.attribute_changes(before, a.select("page", "pos", now.alias("attrs")))
    return out.select("page", F.col("pos").cast("long").alias("pos"), F.array_join("lost", ",").alias("lost"), F.array_join("gained", ",").alias("gained"))


@query("""SELECT (SELECT count(DISTINCT text) FROM conversations) AS cleared, 0 AS answers, 0 AS owners, (SELECT count(*) FROM conversations) AS logged""")
def cleared_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "conversations")
    cache = log.where("text is not null").select(F.sha2("text", 256).alias("cache_key")).distinct()
    answers, owners, cleared = runs.cleared(cache, log.select("conv_id", "text"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return cleared.crossJoin(count(answers, "answers")).crossJoin(count(owners, "owners")).crossJoin(count(log, "logged"))  # one row each


def _model_form(c: str) -> str:
    """for_model in SQL for texts without quotation marks and apostrophes: RE2 has no look-behind, so
    marks that stay are set aside first, twice as matches share a character."""
    t = f"regexp_replace(lower(coalesce({c}, '')), '([;:!?()\\[\\]])', ' \\1 ', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, '(\\d),(\\d)', '\\1\ue000\\2', 'g')"
    t = f"replace(replace({t}, ',', ' , '), '\ue000', ',')"
    for _ in range(2):
        t = f"regexp_replace({t}, '(^|[^\\p{{L}}])(\\p{{L}})\\.', '\\1\\2\ue001', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, '(\\d)\\.(\\d)', '\\1\ue001\\2', 'g')"
    return q.collapsed(f"replace(replace({t}, '.', ' . '), '\ue001', '.')")


_PLAIN = "NOT regexp_matches(coalesce(text, ''), '[\"''“”]')"


@query(f"""SELECT doc_id, substring(sha256({_model_form('text')}), 1, 16) AS model_form, {_model_form('text')} IS DISTINCT FROM text AS changed FROM documents WHERE {_PLAIN}""")
def model_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form that document models take, of texts without quotation marks and apostrophes."""
    text = F.col("text")
    d = table(spark, sf_dir, "documents").where(~F.coalesce(text, F.lit("")).rlike("[\"'“”]"))
    return d.select("doc_id", sha16(for_model(text)).alias("model_form"), (~for_model(text).eqNullSafe(text)).alias("changed"))


@query(rf"""WITH m AS (SELECT doc_id, text, {_model_form('text')} AS x FROM documents WHERE lang <> 'de' AND text IS NOT NULL AND {_PLAIN}),
t AS (SELECT doc_id, text, {q.collapsed(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\(\s*\)', ' ', 'g'), '\s+([,.;:!?)\]])', '\1', 'g'), '([(\[])\s+', '\1', 'g'), '([,;])(\p{L})', '\1 \2', 'g')")} AS x FROM m),
k AS (SELECT doc_id, regexp_extract_all(text, '\p{{L}}+|[.?!]') AS k FROM t), j AS (SELECT doc_id, unnest(k) AS w, unnest(range(1, len(k) + 1)) AS i, k FROM k),
names AS (SELECT doc_id, lower(w) AS lw, arg_min(w, i) AS name FROM j WHERE i > 1 AND k[i - 1] NOT IN ('.', '?', '!') AND regexp_matches(w, '^\p{{Lu}}') GROUP BY ALL),
p AS (SELECT doc_id, regexp_extract_all(x, '\p{{L}}+|[^\p{{L}}]+') AS p FROM t), e AS (SELECT doc_id, unnest(p) AS w, unnest(range(1, len(p) + 1)) AS i, p FROM p),
c AS (SELECT e.doc_id, i, coalesce(name, w) AS w, regexp_matches(w, '^\p{{L}}') AND (i = 1 OR (i = 2 AND NOT regexp_matches(p[1], '^\p{{L}}')) OR regexp_matches(coalesce(p[i - 1], ''), '[.?!]')) AS opens FROM e LEFT JOIN names n ON n.doc_id = e.doc_id AND n.lw = lower(e.w)),
o AS (SELECT doc_id, string_agg(CASE WHEN opens THEN upper(w[1:1]) || w[2:] ELSE w END, '' ORDER BY i) AS x FROM c GROUP BY doc_id)
SELECT doc_id, substring(sha256(coalesce(x, '')), 1, 16) AS prose_form FROM t LEFT JOIN o USING (doc_id)""".replace("LEFT JOIN o USING", "LEFT JOIN (SELECT doc_id AS doc_id, x AS y FROM o) USING").replace("coalesce(x, '')), 1, 16) AS prose_form", "coalesce(y, '')), 1, 16) AS prose_form"))
def prose_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts taken to the models' form and back, without quotation marks, apostrophes and the sharp s
    (whose capital differs between engines)."""
    text = F.col("text")
    d = table(spark, sf_dir, "documents").where((F.col("lang") != "de") & text.isNotNull() & ~text.rlike("[\"'“”]"))
    return d.select("doc_id", sha16(from_model(for_model(text), text)).alias("prose_form"))


@query(f"""WITH {_PAIRS}, r AS (SELECT source, target FROM p WHERE NOT regexp_matches(source || target, '[\"''“”]'))
SELECT 'source' AS system, count(*) FILTER ({_model_form('source')} <> source) AS changed, count(*) AS n FROM r UNION ALL SELECT 'target', count(*) FILTER ({_model_form('target')} <> target), count(*) FROM r""")
def normalised_before_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_pairs(spark, sf_dir).where("source is not null").where(~F.concat("source", "target").rlike("[\"'“”]"))
    return metrics.normalised_for_scoring(rows, ["source", "target"], for_model)[1]


@query("""SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events""")
def event_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", epoch_ms(at).alias("ms"), iso_utc(at).alias("iso"), compact_stamp(at).alias("stamp"))


#: The test texts hold no broken encodings: marks of addresses are made into some.
_DAMAGED = "CASE WHEN doc_id % 2 = 0 THEN replace(replace(coalesce(text, ''), '@', 'â€™'), 'http', 'Ã©') ELSE replace(coalesce(text, ''), '@', 'âz') END"
_STRICT = "(contains(t, 'â') OR contains(t, 'Ã'))"
_TARGETED = r"regexp_matches(t, 'â\s*''''|â\s*€\s*™|Ã\s*©|Ã\s*¹|Ã\s*¶|â\s*€\s*œ|â\s*€\s*')"


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    even = F.replace(F.replace(t, F.lit("@"), F.lit("â€™")), F.lit("http"), F.lit("Ã©"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, even).otherwise(F.replace(t, F.lit("@"), F.lit("âz"))).alias("t"))


@query(f"""WITH d AS (SELECT doc_id, {_DAMAGED} AS t FROM documents), f AS (SELECT {_STRICT} AS a, {_TARGETED} AS b FROM d)
SELECT count(*) AS total, count(*) FILTER (a) AS strict_drops, count(*) FILTER (b) AS targeted_drops, count(*) FILTER (a AND b) AS both_drop,
 count(*) FILTER (a AND NOT b) AS only_strict, count(*) FILTER (b AND NOT a) AS only_targeted, count(*) FILTER (NOT a) AS strict_keeps, count(*) FILTER (NOT b) AS targeted_keeps FROM f""")
def filter_divergence_of_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both filters with their own marks."""
    return op.filter_divergence(_damaged(spark, sf_dir), "t")


@query(f"""WITH d AS (SELECT doc_id, {_DAMAGED} AS t FROM documents), f AS (SELECT doc_id, t, {_STRICT} AS a, {_TARGETED} AS b FROM d)
SELECT doc_id, CASE WHEN a THEN 'strict' ELSE 'targeted' END AS only, substring(t, 1, 200) AS example FROM f WHERE a <> b ORDER BY doc_id LIMIT 12""")
def filter_divergence_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.divergence_examples(_damaged(spark, sf_dir), "doc_id", "t")


@query(f"""WITH d AS (SELECT doc_id, {_DAMAGED} AS t FROM documents) SELECT 'none' AS mode, count(*) AS kept FROM d UNION ALL SELECT 'strict', count(*) FILTER (NOT {_STRICT}) FROM d
UNION ALL SELECT 'targeted', count(*) FILTER (NOT {_TARGETED}) FROM d""")
def pairs_kept_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each filter mode, white space collapsed before the strict one."""
    pairs = _damaged(spark, sf_dir).select(F.col("t").alias("source"), F.col("lang").alias("target"))
    each = [op.clean_pairs(pairs, m, collapse_first=m == "strict").agg(F.lit(m).alias("mode"), F.count("*").alias("kept")) for m in ("none", "strict", "targeted")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"""WITH l AS (SELECT doc_id, {q.norm('text')} AS norm, text FROM documents), r AS (SELECT DISTINCT {q.norm('text')} AS norm FROM documents WHERE source IN ('src1', 'src2')),
h AS (SELECT doc_id, text FROM l JOIN r USING (norm))
SELECT doc_id AS idx, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 5 THEN substring(text, 1, 220) END AS example FROM h""")
def overlap_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op.overlap_examples(docs.select(F.col("doc_id").alias("idx"), "text"), docs.where(F.col("source").isin("src1", "src2")).select("text"))


_COUNT = r"len(regexp_extract_all(regexp_replace(coalesce({0}, ''), '[\t-\r ]+$', ''), '[.!?]+([\t-\r ]+|$)')) + CASE WHEN regexp_matches(coalesce({0}, ''), '[^\t-\r ]') AND NOT regexp_matches(regexp_replace(coalesce({0}, ''), '[\t-\r ]+$', ''), '[.!?]$') THEN 1 ELSE 0 END"


@query("""SELECT event_type, count(*) AS requests, round(count(*) / 90.0, 2) AS requests_per_second, round(sum(length(props)) / 90.0, 1) AS chars_per_second FROM events GROUP BY event_type""")
def request_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.length("props").alias("chars"))
    return audit.throughput(e, 90_000.0, "chars", "event_type")


@query(f"""WITH i AS (SELECT lang, CASE WHEN {q.collapsed('text')} = '' THEN 'empty' WHEN len({q.words('text')}) < 4 THEN 'short' WHEN n_chars > 5000 THEN 'long' WHEN source = 'src1' THEN 'from-src1' END AS reason FROM documents),
n AS (SELECT lang, reason, count(*) AS n FROM i WHERE reason IS NOT NULL GROUP BY ALL)
SELECT lang, reason, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM i) CROSS JOIN (SELECT DISTINCT reason FROM n) LEFT JOIN n USING (lang, reason)""")
def reasons_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever reasons occur make the table."""
    from prosemill.functions.text import collapsed, word_list

    t = collapsed(F.col("text"))
    reason = F.when(t == "", "empty").when(F.size(word_list(t)) < 4, "short").when(F.col("n_chars") > 5000, "long").when(F.col("source") == "src1", "from-src1")
    return audit.reason_table(table(spark, sf_dir, "documents").select("lang", reason.alias("reason")), "lang", "reason")


@query("""SELECT doc_id AS idx, length(text) AS left_chars, quality FROM documents JOIN labels USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def aligned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts next to their labels, position by position, without the toxic ones."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), "quality", "toxic")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.length("text").cast("long").alias("left_chars")).join(labels.select("idx"), "idx", "left_semi")
    both = op.aligned(docs, labels.select("idx", "quality"))
    return op.excluded(both, labels.where("toxic = 1").select("idx"))


@query(f"""WITH {_PAIRS}, w AS (SELECT conv_id % 4 AS arm, {{a}} AS a, {{b}} AS b FROM p) SELECT arm, count(*) FILTER (b > a) AS split, count(*) FILTER (b < a) AS merged FROM w GROUP BY arm""".format(
    a=_COUNT.format("source"), b=_COUNT.format("target")))
def split_and_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.rewritten_sentences(turn_pairs(spark, sf_dir).withColumn("arm", F.col("conv_id") % 4), "source", "target", review_sentences, "arm")


@query(f"""WITH {_PAIRS}, w AS (SELECT conv_id % 2 AS cut, conv_id % 5 AS arm, len({q.words('source')}) AS a, len({q.words('target')}) AS b, {q.collapsed('source')} <> {q.collapsed('target')} AS changed FROM p),
g AS (SELECT cut, arm, round(avg(b), 6) AS mean_words, round(avg(changed::INT), 6) AS changed_share, round(max(b / greatest(a, 1)), 6) AS longest FROM w GROUP BY cut, arm),
l AS (SELECT cut, arm, 'mean_words' AS score, mean_words AS value, false AS higher FROM g UNION ALL SELECT cut, arm, 'changed_share', changed_share, true FROM g UNION ALL SELECT cut, arm, 'longest', longest, false FROM g)
SELECT cut, arm, score, value, value = CASE WHEN higher THEN max(value) OVER w ELSE min(value) OVER w END AS best FROM l WINDOW w AS (PARTITION BY cut, score)""")
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_pairs(spark, sf_dir).withColumn("cut", F.col("conv_id") % 2).withColumn("arm", F.col("conv_id") % 5)
    a, b = runs.word_count(F.col("source")), runs.word_count(F.col("target"))
    scores = {
        "mean_words": runs.Score(b, F.avg, False),
        "changed_share": runs.Score(runs.is_changed(F.col("source"), F.col("target")).cast("int"), F.avg),
        "longest": runs.Score(b / F.greatest(a, F.lit(1)), F.max, False),
    }
    return runs.comparison_report(rows, "cut", "arm", scores)
