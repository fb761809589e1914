"""Queries over web pages and simplification requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions.normalise import for_model, from_model
from prosemill.functions.text import OVERLAP_STOP_WORDS, OVERLAP_TOKEN, collapsed, sha16
from prosemill.operators import audit, page_units, runs, simplifier, write_back
from prosemill.plans import sql as q
from prosemill.plans.registry import query, table


#: The test pages' leaf elements: a start tag and all up to the next tag that isn't a link, bold or a
#: line break; what is in the article is in scope, its lists and all but footers and menus are content.
_LEAF = "<(li|div|h1|p|footer)(?: [^>]*)?>([^<]*(?:<(?:/?[ab]|a [^>]*|br)>[^<]*)*)"
_UNENTITLED = "x"
for _name, _char in (("copy", "©"), ("middot", "·"), ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
    _UNENTITLED = f"replace({_UNENTITLED}, '&{_name};', '{_char}')"
_PART = f"SELECT page_id, {{0}} AS part, regexp_extract_all({{1}}, '{_LEAF}', 1) AS tags, regexp_extract_all({{1}}, '{_LEAF}', 2) AS texts FROM pages WHERE html IS NOT NULL"
_HTML_UNITS = rf"""parts AS ({_PART.format(0, "split_part(split_part(html, '</head>', 2), '<article>', 1)")} UNION ALL {_PART.format(1, "split_part(split_part(html, '<article>', 2), '</article>', 1)")}
 UNION ALL {_PART.format(2, "split_part(html, '</article>', 2)")}),
leaves AS (SELECT page_id, part, unnest(range(len(tags))) AS i, unnest(tags) AS tag, unnest(texts) AS content FROM parts),
placed AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY part, i) - 1 AS pos FROM leaves),
cut AS (SELECT *, string_split(content, '<br>') AS pieces FROM placed),
raw AS (SELECT page_id, part, pos, tag, regexp_replace(content, '<[^>]*>', '', 'g') AS el, unnest(range(len(pieces))) AS chunk, regexp_replace(unnest(pieces), '</?[ab][^>]*>', '', 'g') AS x FROM cut),
chunked AS (SELECT page_id, pos, chunk, tag, part = 1 AS in_scope, tag = 'footer' OR (tag = 'li' AND part = 0) AS boilerplate, {_UNENTITLED.replace('(x,', '(el,', 1)} AS el, {_UNENTITLED} AS line FROM raw),
units AS (SELECT *, CASE WHEN {q.collapsed('el')} = '' THEN 'no-text' WHEN regexp_matches(el, '\b(function|var|let|const|=>)\b|[{{}}<>;=]') THEN 'code-like-text' WHEN {q.collapsed('line')} = '' THEN 'empty-chunk' WHEN regexp_matches({q.collapsed('line')}, 'https?://') THEN 'bare-url'
 WHEN len({q.words('line')}) < 4 THEN 'under-min-words' WHEN NOT regexp_matches({q.collapsed('line')}, '\p{{L}}') THEN 'no-letters' END AS reason, len({q.words('line')}) AS words FROM chunked),
document AS (SELECT *, CASE WHEN tag = 'h1' THEN 'section-heading' WHEN tag IN ('div', 'footer') THEN 'not-document-body-tag' ELSE reason END AS document_reason FROM units)"""


@query(f"WITH {_HTML_UNITS} SELECT page_id, pos, chunk, tag, in_scope, boilerplate, reason, words FROM units")
def html_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = page_units.with_reasons(page_units.page_units(table(spark, sf_dir, "pages")))
    return units.select("page_id", "pos", "chunk", "tag", "in_scope", "boilerplate", "reason", runs.word_count(F.col("raw")).alias("words"))


@query(f"WITH {_HTML_UNITS} SELECT tag, coalesce(document_reason, 'sent') AS reason, count(*) AS n FROM document GROUP BY ALL")
def html_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = page_units.with_reasons(page_units.page_units(table(spark, sf_dir, "pages")), document=True)
    return units.groupBy("tag", F.coalesce("reason", F.lit("sent")).alias("reason")).agg(F.count("*").alias("n"))


@query(rf"""WITH RECURSIVE {_HTML_UNITS}, numbered AS (SELECT *, pos * 100000 + chunk AS place, sum((tag = 'h1' AND chunk = 0)::INT) OVER (PARTITION BY page_id ORDER BY pos, chunk ROWS UNBOUNDED PRECEDING) AS section FROM document),
u AS (SELECT page_id, section, place, row_number() OVER (PARTITION BY page_id, section ORDER BY place) AS k, CAST(ceil(words * 1.6) AS BIGINT) AS n FROM numbered WHERE in_scope AND document_reason IS NULL),
f AS (SELECT page_id, section, place, k, n, n AS t, 0 AS g FROM u WHERE k = 1 UNION ALL
 SELECT u.page_id, u.section, u.place, u.k, u.n, CASE WHEN f.t > 0 AND f.t + u.n > 512 THEN u.n ELSE f.t + u.n END, f.g + (CASE WHEN f.t > 0 AND f.t + u.n > 512 THEN 1 ELSE 0 END)
 FROM f JOIN u ON u.page_id = f.page_id AND u.section = f.section AND u.k = f.k + 1)
SELECT page_id, section, place AS "at", n AS tokens, g AS group_no FROM f""")
def html_section_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_units.section_groups(page_units.page_units(table(spark, sf_dir, "pages")))


@query(f"""WITH {_HTML_UNITS} SELECT tag, count(*) FILTER (reason IS NOT NULL AND in_scope AND words >= 12) AS prose_skipped, coalesce(sum(words) FILTER (reason IS NOT NULL AND in_scope AND words >= 12), 0) AS prose_skipped_words,
 count(*) FILTER (reason IS NULL AND boilerplate) AS boilerplate_sent, count(*) FILTER (reason IS NULL AND NOT in_scope) AS sent_outside FROM units GROUP BY tag""")
def html_selection_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = page_units.with_reasons(page_units.page_units(table(spark, sf_dir, "pages")))
    items = units.select(
        "tag", F.when(F.col("reason").isNull(), "sent").otherwise("skipped").alias("status"), "in_scope", F.col("boilerplate").alias("in_boilerplate"), runs.word_count(F.col("raw")).alias("words")
    )
    return audit.selection_analysis(items, "tag")


@query("""SELECT page_id, substring(sha256(html), 1, 16) AS sha, strlen(html) AS bytes FROM pages WHERE html IS NOT NULL""")
def page_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where("html is not null").select("page_id", sha16(F.col("html")).alias("sha"), F.octet_length("html").cast("long").alias("bytes"))


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) AS tag, page_id % 2 AS side FROM pages), b AS (SELECT page_id // 2 AS page, tag, count(*) AS n FROM t WHERE side = 0 GROUP BY ALL), a AS (SELECT page_id // 2 AS page, tag, count(*) AS n FROM t WHERE side = 1 GROUP BY ALL)
SELECT page, tag, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after FROM b FULL JOIN a USING (page, tag) WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)""")
def snapshot_tag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring pages stand in for a page before and after."""
    t = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)[ >]"), F.lit(1))).alias("tag"))
    n = t.groupBy(F.floor(F.col("page_id") / 2).cast("long").alias("page"), (F.col("page_id") % 2).alias("side"), "tag").agg(F.count("*").alias("n"))
    return audit.tag_changes(n.where("side = 0").drop("side"), n.where("side = 1").drop("side"))


@query(rf"""WITH c AS (SELECT row_number() OVER () AS rn, conv_id * 1000 + turn AS request_id, role, {q.strip("CASE WHEN turn % 3 = 1 THEN text || ' Of 42 things.' ELSE text END")} AS t FROM conversations),
s AS (SELECT rn, request_id, role, list_filter(CASE WHEN regexp_matches(t, '[\n\r\t]') THEN string_split(regexp_replace(t, '{q.WS}+', ' ', 'g'), ' ') ELSE string_split(regexp_replace(t, '([.!?]){q.WS}+', '\1' || chr(1), 'g'), chr(1)) END, lambda x: x <> '') AS s FROM c),
k AS (SELECT DISTINCT unnest(s) AS x FROM s WHERE role = 'assistant'), e AS (SELECT rn, unnest(s) AS x FROM s),
g AS (SELECT rn, bool_and(k.x IS NOT NULL) AS cached, bool_or(regexp_matches(e.x, '[0-9]')) AS numbers FROM e LEFT JOIN k ON k.x = e.x GROUP BY rn)
SELECT request_id, array_to_string(s, ' ') AS simplified, cached, CASE WHEN numbers THEN 'no_meaningful_change' END AS reason, len(s) AS sentences FROM s JOIN g USING (rn)""")
def simplified_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole request path with a stub that drops numbers, which the guard rejects; every third
    turn gets some, and what assistants said is cached."""
    text = F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" Of 42 things."))).otherwise(F.col("text"))
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "role", text.alias("text"))
    stub = simplifier.Stub("guard")
    keys = c.where("role = 'assistant'").select(F.lit(stub.model_id).alias("model"), F.lit("general").alias("audience"), F.explode(simplifier.serving_sentences(F.col("text"))).alias("text"))
    return simplifier.simplify(c, stub, stub.answers(keys.distinct())).select("request_id", "simplified", "cached", "reason", "sentences")


def _asked(text: str, audience: str, seconds: float) -> str:
    """A service that fails by a text's length."""
    if len(text) % 7 == 0:
        raise TimeoutError
    if len(text) % 11 == 0:
        raise simplifier.Busy(503, 0.0)
    if len(text) % 13 == 0:
        raise ValueError("no such model")
    return text


@query(rf"""WITH c AS (SELECT row_number() OVER () AS rn, {q.strip('text')} AS t FROM conversations),
s AS (SELECT rn, unnest(list_filter(CASE WHEN regexp_matches(t, '[\n\r\t]') THEN string_split(regexp_replace(t, '{q.WS}+', ' ', 'g'), ' ') ELSE string_split(regexp_replace(t, '([.!?]){q.WS}+', '\1' || chr(1), 'g'), chr(1)) END, lambda x: x <> '')) AS x FROM c)
SELECT CASE WHEN length(x) % 7 = 0 THEN 'timeout' WHEN length(x) % 11 = 0 OR length(x) % 13 = 0 THEN 'error' ELSE 'answered' END AS result, count(*) AS n FROM s GROUP BY 1""")
def endpoint_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by what a service that is often busy, slow or broken made of them."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "text")
    out = simplifier.simplify(c, simplifier.Endpoint("service", _asked, attempts=2), None)
    answered = F.array_repeat(F.lit("answered"), F.col("sentences") - F.size("reasons"))
    return out.select(F.explode(F.concat("reasons", answered)).alias("result")).groupBy("result").agg(F.count("*").alias("n"))


@query()
def normalised_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    model = for_model(text)
    return table(spark, sf_dir, "documents").select("doc_id", sha16(model).alias("model_form"), sha16(from_model(model, text)).alias("prose_form"), (collapsed(text) != model).alias("changed"))


def _vocabulary(c: str) -> str:
    listed = ", ".join(f"'{w}'" for w in OVERLAP_STOP_WORDS)
    return f"list_distinct(list_filter({q.all_of(f'lower({c})', OVERLAP_TOKEN)}, lambda w: w NOT IN ({listed})))"


_SIZE = r"len(list_filter(string_split_regex({}, '\s+'), lambda w: w <> ''))"


@query(rf"""WITH RECURSIVE c AS MATERIALIZED (SELECT conv_id AS id, list(text ORDER BY turn, role, text) AS units FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
t AS MATERIALIZED (SELECT id, units, list_filter(string_split(regexp_replace(trim(array_to_string(units, ' '), ' ' || chr(10) || chr(9)), '([.?!]["''”’)\]]?)\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS told FROM c),
v AS MATERIALIZED (SELECT id, len(units) AS n, len(told) AS m, list_transform(units, lambda u: {_vocabulary('u')}) AS known, list_transform(told, lambda s: {_vocabulary('s')}) AS spoken,
 list_transform(told, lambda s: {_SIZE.format('s')}) AS length, list_transform(units, lambda u: {_SIZE.format('u')}) AS size FROM t),
w AS MATERIALIZED (SELECT *, list_transform(size, lambda k: list_sum(length) * k / (CASE WHEN list_sum(size) = 0 THEN n ELSE list_sum(size) END)) AS share FROM v),
f AS (SELECT id, 0 AS i, 1 AS unit, 0::HUGEINT AS had FROM w UNION ALL
 SELECT f.id, f.i + 1, CASE WHEN x.moves THEN f.unit + 1 ELSE f.unit END, CASE WHEN x.moves THEN 0 ELSE f.had END + w.length[f.i + 1]
 FROM f JOIN w ON w.id = f.id AND f.i < w.m, LATERAL (SELECT CASE WHEN f.had > 0 AND f.unit < w.n THEN len(list_intersect(w.spoken[f.i + 1], w.known[f.unit + 1])) - len(list_intersect(w.spoken[f.i + 1], w.known[f.unit])) ELSE -1 END AS lead) l,
 LATERAL (SELECT l.lead > 0 OR l.lead = 0 AND (f.had >= w.share[f.unit] OR w.m - f.i < w.n - f.unit + 1) AS moves) x),
p AS (SELECT t.id, u.k, coalesce(string_agg(t.told[f.i], ' ' ORDER BY f.i), '') AS part, any_value(t.units[u.k]) AS unit FROM t, LATERAL (SELECT unnest(range(1, len(t.units) + 1)) AS k) u LEFT JOIN f ON f.id = t.id AND f.unit = u.k AND f.i > 0 GROUP BY t.id, u.k)
SELECT id, substring(sha256(string_agg(part, '|' ORDER BY k)), 1, 16) AS parts, count(*) FILTER (part <> '' AND trim(part) <> trim(unit)) AS written, count(*) FILTER (NOT (part <> '' AND trim(part) <> trim(unit))) AS unwritten FROM p GROUP BY id""")
def distributed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for whole conversations dealt back to their turns: the parts' fingerprint, and how many
    turns are written and unwritten."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"])
    rows = c.groupBy(F.col("conv_id").alias("id")).agg(turns.alias("units")).withColumn("answer", F.array_join("units", " "))
    out = write_back.distributed_sentences(rows).join(rows, "id").select("id", sha16(F.array_join("parts", "|")).alias("parts"), write_back.coverage().alias("c"))
    return out.select("id", "parts", "c.written", "c.unwritten")


_NODE = "d.texts[f.i + 1]"
_FLAT = r"trim(regexp_replace(" + _NODE + r", '\s+', ' ', 'g'))"


@query(rf"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id AS id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)) AS texts, {q.collapsed('text')} AS output FROM documents),
f AS (SELECT id, 0 AS i, 1::BIGINT AS onward, 0::BIGINT AS spot, '' AS found FROM d UNION ALL
 SELECT f.id, f.i + 1, CASE WHEN h.place > 0 THEN f.onward + h.place - 1 + length(h.t) ELSE f.onward END, CASE WHEN h.place > 0 THEN f.onward + h.place - 1 ELSE 0 END, CASE WHEN h.place > 0 THEN h.t ELSE '' END
 FROM f JOIN d ON d.id = f.id AND f.i < len(d.texts), LATERAL (SELECT CASE WHEN length({_NODE}) >= 3 THEN instr(substr(d.output, f.onward), {_NODE}) ELSE 0 END AS p, CASE WHEN length({_NODE}) >= 3 THEN instr(substr(d.output, f.onward), {_FLAT}) ELSE 0 END AS pf) x,
 LATERAL (SELECT CASE WHEN x.p > 0 THEN x.p ELSE x.pf END AS place, CASE WHEN x.p > 0 THEN {_NODE} ELSE {_FLAT} END AS t) h),
a AS (SELECT id, i, spot, found, lag(i, 1, 0) OVER w AS previous, coalesce(lag(spot + length(found)) OVER w, 1) AS since FROM f WHERE spot > 0 WINDOW w AS (PARTITION BY id ORDER BY i)),
l AS (SELECT d.id, len(d.texts) AS n, d.output, coalesce(max(a.i), 0) AS latest, coalesce(max(a.spot + length(a.found)), 1) AS since FROM d LEFT JOIN a USING (id) GROUP BY ALL),
c AS (SELECT a.id, CASE WHEN a.previous + 1 < a.i OR a.i = 1 THEN a.previous + 1 ELSE a.i - 1 END AS i, 2 * a.i AS seq, substr(d.output, a.since, a.spot - a.since) AS t FROM a JOIN d USING (id)
 UNION ALL SELECT id, i, 2 * i + 1, found FROM a UNION ALL SELECT id, CASE WHEN latest < n THEN latest + 1 ELSE n END, 2 * n + 2, substr(output, since) FROM l),
p AS (SELECT l.id, k.k, coalesce(string_agg(c.t, '' ORDER BY c.seq), '') AS part FROM l, LATERAL (SELECT unnest(range(1, l.n + 1)) AS k) k LEFT JOIN c ON c.id = l.id AND c.i = k.k GROUP BY l.id, k.k)
SELECT id, count(*) AS nodes, substring(sha256(string_agg(part, '|' ORDER BY k)), 1, 16) AS parts FROM p GROUP BY id""")
def aligned_text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document as nodes, its text as the output: the nodes' number and the fingerprint of
    what each gets."""
    d = table(spark, sf_dir, "documents")
    texts = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x))  # of F.trim itself the index would be the characters to trim
    off = F.transform(texts, lambda _: F.lit(False))
    out = write_back.aligned_nodes(d.select(F.col("doc_id").alias("id"), texts.alias("texts"), collapsed(F.col("text")).alias("output"), off.alias("nested"), off.alias("pinned")))
    return out.select("id", F.size("parts").cast("long").alias("nodes"), sha16(F.array_join("parts", "|")).alias("parts"))
