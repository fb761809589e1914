"""Queries over documents, benchmark and conversations as corpora."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions.text import CONTENT_STOP_WORDS, collapsed, ngrams, overlap_norm, sha16
from prosemill.operators import corpus as op
from prosemill.operators.audit import hash_sample
from prosemill.plans import sql as q
from prosemill.plans.registry import query, table

#: The test texts hold no broken encodings, so these marks stand in for them.
STRICT, TARGETED = ("@",), (r"@\w+\d", r"\$\$\$")


@query(rf"""
WITH d AS (SELECT lang AS split, {q.collapsed('text')} AS t, contains(coalesce(text, ''), '@') AS gone FROM documents),
w AS (SELECT split, gone, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM d),
v AS (SELECT split, count(DISTINCT x) AS vocabulary FROM (SELECT split, unnest(list_transform(w, lambda x: lower(x))) AS x FROM w WHERE NOT gone) GROUP BY split)
SELECT w.split, count(*) AS raw, count(*) FILTER (gone) AS dropped, count(*) FILTER (NOT gone) AS kept,
  round_even(avg(len(w)) FILTER (NOT gone), 1) AS mean_words, quantile_cont(len(w), 0.5) FILTER (NOT gone) AS median_words,
  min(len(w)) FILTER (NOT gone) AS min_words, max(len(w)) FILTER (NOT gone) AS max_words, coalesce(any_value(vocabulary), 0) AS vocabulary
FROM w LEFT JOIN v USING (split) GROUP BY w.split""")
def corpus_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op.split_statistics(docs, "lang", "text", op.is_damaged(F.coalesce("text", F.lit("")), "strict", STRICT))


@query(r"""
WITH d AS (SELECT contains(coalesce(text, ''), '@') AS a, regexp_matches(coalesce(text, ''), '@\w+\d|\$\$\$') AS b FROM documents)
SELECT count(*) AS total, count(*) FILTER (a) AS strict_drops, count(*) FILTER (b) AS targeted_drops, count(*) FILTER (a AND b) AS both_drop,
  count(*) FILTER (a AND NOT b) AS only_strict, count(*) FILTER (b AND NOT a) AS only_targeted, count(*) FILTER (NOT a) AS strict_keeps, count(*) FILTER (NOT b) AS targeted_keeps FROM d""")
def filter_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.filter_divergence(table(spark, sf_dir, "documents"), "text", STRICT, TARGETED)


@query(rf"""
SELECT conv_id AS idx, turn, {q.collapsed('text')} AS source, {q.collapsed('answer')} AS target FROM (
  SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS answer FROM conversations)
WHERE answer IS NOT NULL AND NOT contains(coalesce(text, ''), '@') AND NOT contains(answer, '@')""")
def clean_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.clean_pairs(turn_pairs(spark, sf_dir), "strict", strict=STRICT).select(F.col("conv_id").alias("idx"), "turn", "source", "target")


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, source, target: each turn and the one after it."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (
        table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("source"), F.lead("text").over(w).alias("target"))
        .where("target is not null")
    )


@query(rf"""
WITH l AS (SELECT doc_id, {q.norm('text')} AS norm FROM documents), r AS (SELECT DISTINCT {q.norm('text')} AS norm FROM documents WHERE source IN ('src1', 'src2'))
SELECT count(*) AS left_items, count(DISTINCT l.norm) AS left_unique, count(r.norm) AS overlapping,
  round_even(100.0 * count(r.norm) / greatest(count(*), 1), 2) AS overlap_pct FROM l LEFT JOIN r ON l.norm = r.norm""")
def overlap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op.overlap_audit(docs.select(F.col("doc_id").alias("idx"), "text"), docs.where(F.col("source").isin("src1", "src2")).select("text"))


@query(rf"""
SELECT sha256(norm) AS norm_sha, min(doc_id) AS first, count(*) AS copies FROM (SELECT doc_id, {q.norm('text')} AS norm FROM documents)
WHERE norm <> '' GROUP BY norm HAVING count(*) > 1""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(rf"""
WITH c AS (SELECT conv_id * 1000 + turn AS id, role, list_distinct(string_split({q.norm('text')}, ' ')) AS t FROM conversations WHERE {q.norm('text')} <> ''),
r AS (SELECT id, t FROM c WHERE role = 'assistant')
SELECT DISTINCT c.id AS lid, r.id AS rid, round(len(list_intersect(c.t, r.t)) / len(list_distinct(list_concat(c.t, r.t))), 6) AS jaccard
FROM c, r WHERE len(list_intersect(c.t, r.t)) * 100 >= 50 * len(list_distinct(list_concat(c.t, r.t)))""")
def near_duplicates_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("lid"), "role", "text")
    right = c.where("role = 'assistant'").withColumnRenamed("lid", "rid")
    return op.jaccard_matches(c, right, 50).select("lid", "rid", F.round("jaccard", 6).alias("jaccard")).distinct()


@query(rf"""
SELECT d.doc_id, b.item_id FROM (SELECT doc_id, {q.norm('text')} AS n FROM documents) d JOIN (SELECT item_id, {q.norm('text')} AS n FROM benchmark) b
ON contains(d.n, b.n) AND len(string_split(b.n, ' ')) >= 3""")
def benchmark_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole benchmark item of three words or more.

    Joined on up to eight of the item's words after the first (which, like the last, may end a longer
    word of the document), then checked.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", overlap_norm(F.col("text")).alias("n"))
    items = table(spark, sf_dir, "benchmark").select("item_id", overlap_norm(F.col("text")).alias("m"))
    words = F.split("m", " ")
    items = items.withColumn("k", F.least(F.size(words) - 2, F.lit(8))).where("k > 0")
    items = items.withColumn("head", F.array_join(F.slice(words, F.lit(2), F.col("k")), " "))
    sizes = sorted(r.k for r in items.select("k").distinct().collect())  # at most eight
    grams = F.array_distinct(F.flatten(F.array(*[ngrams(F.split("n", " "), k) for k in sizes])))
    met = docs.select("doc_id", F.explode(grams).alias("head")).join(items, "head").select("doc_id", "item_id", "m")
    return met.join(docs, "doc_id").where(F.contains("n", "m")).select("doc_id", "item_id").distinct()


@query(r"""
SELECT lang, source, rank, doc_id FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(text), doc_id) AS rank FROM documents) WHERE rank <= 3""")
def stratified_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "text")
    return hash_sample(docs.select("lang", "source", "doc_id", "text"), ["lang", "source"], "text").select("lang", "source", F.col("rank").cast("long").alias("rank"), "doc_id")


@query(rf"""SELECT conv_id, substring(sha256(string_agg({q.collapsed('text')}, chr(10) ORDER BY turn, role, text)), 1, 16) AS fingerprint, count(*) AS n
FROM conversations GROUP BY conv_id""")
def session_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of each session: SHA-256 of its texts in order."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    joined = F.array_join(F.transform(rows, lambda x: collapsed(x["text"])), "\n")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(sha16(joined).alias("fingerprint"), F.count("*").alias("n"))


@query(rf"""
WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS answer FROM conversations)
SELECT count(*) AS rows, count(*) FILTER (regexp_matches({q.strip('answer')}, '^\p{{Lu}}') AND regexp_matches({q.strip('answer')}, '[.!?]$')
  AND NOT regexp_matches({q.strip('answer')}, '[,;:][\t-\r ]*[.!?]$|\.\.|,,|[\t-\r ],')) AS well_formed FROM t WHERE answer IS NOT NULL""")
def well_formed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).agg(F.count("*").alias("rows"), F.count_if(op.well_formed(F.col("target"))).alias("well_formed"))


_ORDERS = ", ".join(f"({n}, {i}, {rank})" for n in (40, 200) for rank, i in enumerate(random.Random(42).sample(range(n), n)))
_FIT = rf"""regexp_matches({q.strip('r')}, '^\p{{Lu}}') AND regexp_matches({q.strip('r')}, '[.!?]$') AND NOT regexp_matches({q.strip('r')}, '[,;:][\t-\r ]*[.!?]$|\.\.|,,|[\t-\r ],')
 AND len(list_filter(regexp_extract_all(r, '[A-Za-z][A-Za-z''-]*'), lambda w: lower(w) NOT IN ({', '.join(f"'{w}'" for w in CONTENT_STOP_WORDS)}))) > 0"""


@query(rf"""WITH o(total, idx, rank) AS (VALUES {_ORDERS}), b AS (SELECT item_id AS idx, text AS source, [regexp_extract(text, '(?s)^.*?[.!?]'), text] AS refs FROM benchmark WHERE len({q.words('text')}) >= 20),
r AS (SELECT idx, source, unnest(refs) AS r, unnest([1, 2]) AS k FROM b), f AS (SELECT idx, any_value(source) AS source, first({q.strip('r')} ORDER BY k) AS reference FROM r WHERE {_FIT} GROUP BY idx)
SELECT idx, rank, source, reference FROM f JOIN o USING (idx) WHERE o.total = (SELECT count(*) FROM benchmark) ORDER BY rank LIMIT 3""")
def few_shot_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples in the order of a seeded permutation of the benchmark (a bounded table), with the
    item's first sentence and the item itself as references."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("source"))
    pairs = items.withColumn("references", F.array(F.regexp_extract("source", r"(?s)^.*?[.!?]", 0), F.col("source")))
    ids = [r.idx for r in items.select("idx").orderBy("idx").collect()]
    order = random.Random(42).sample(ids, len(ids))
    return op.select_examples(pairs, spark.createDataFrame(list(zip(order, range(len(order)), strict=True)), "idx long, rank int"))


def _drawn(totals: tuple[int, ...], n: int, seed: int) -> str:
    """The indices that random.Random draws of tables of these sizes."""
    return ", ".join(f"({t}, {i})" for t in totals for i in op.seeded_indices(t, n, seed))


@query(f"""WITH v(total, idx) AS (VALUES {_drawn((200, 1000, 10_000), 100, 42)})
SELECT doc_id AS idx, lang FROM documents JOIN v ON v.idx = doc_id AND v.total = (SELECT count(*) FROM documents)""")
def seeded_test_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "lang")
    return op.seeded_sample(docs, 100, 42)
