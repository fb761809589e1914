"""Queries of reviews and reference metrics over turns: source, next turn, and a stub's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.operators import audit, metrics, review
from prosemill.plans import sql as q
from prosemill.plans.corpus import turn_pairs
from prosemill.plans.registry import query, table

_T = """t AS (SELECT conv_id * 1000 + turn AS idx, conv_id, turn, text AS source, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS target FROM conversations),
r AS (SELECT idx, conv_id, source, target AS reference, CASE WHEN turn % 3 = 0 THEN source ELSE regexp_replace(source, '[\\t-\\r ]+[^\\t-\\r ]+[.]', '.', 'g') END AS prediction FROM t WHERE target IS NOT NULL)"""


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, source, reference and a deterministic prediction: the word before each full stop goes,
    except where every third turn is a copy."""
    s = F.col("source")
    cut = F.regexp_replace(s, r"[\t-\r ]+[^\t-\r ]+[.]", ".")
    return turn_pairs(spark, sf_dir).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), "conv_id", s, F.col("target").alias("reference"), F.when(F.col("turn") % 3 == 0, s).otherwise(cut).alias("prediction")
    )


_W = lambda c: q.all_of(f"lower({c})", "[a-z0-9']+")
_S = lambda c: f"len(regexp_extract_all(regexp_replace({q.strip(c)}, '([.!?]){q.WS}+', '\\1' || chr(1), 'g'), '[^\\x01]+'))"
_Y = lambda c: q.all_of(c, r"\b(?:1[5-9][0-9][0-9]|20[0-2][0-9])\b")
_N = lambda c: q.all_of(c, r"[0-9][0-9,.]*")


@query(rf"""WITH {_T}, m AS (SELECT conv_id % 2 AS split, {_W('prediction')} AS p, {_W('source')} AS s, {_W('reference')} AS ref, {_S('prediction')} AS ps, {_S('source')} AS ss, {q.strip('prediction')} AS tp, {q.strip('source')} AS ts,
 {_Y('prediction')} AS py, {_Y('source')} AS sy, {_N('prediction')} AS pn, {_N('source')} AS sn FROM r),
g AS (SELECT *, list_transform(generate_series(1, greatest(len(p) - 4, 0)), lambda i: array_to_string(p[i:i+4], ' ')) AS grams FROM m)
SELECT split, count(*) AS n, round(quantile_cont(len(p) / greatest(len(s), 1), 0.5), 3) AS length_ratio_median, round(quantile_cont(ps / greatest(ss, 1), 0.5), 3) AS sentence_ratio_median,
 round(quantile_cont(len(p) / greatest(ps, 1), 0.5), 2) AS words_per_sentence_median, count(*) FILTER (tp = ts) AS identical,
 count(*) FILTER (len(p) > 0 AND len(list_filter(p, lambda x: list_contains(s, x))) / len(p) > 0.98 AND len(p) / greatest(len(s), 1) > 0.9) AS near_copy, count(*) FILTER (ps > ss) AS split_more,
 count(*) FILTER (len(p) < 0.5 * len(ref)) AS under_half, count(*) FILTER (len(list_filter(py, lambda x: NOT list_contains(sy, x))) > 0) AS new_year, count(*) FILTER (len(list_filter(pn, lambda x: NOT list_contains(sn, x))) > 0) AS new_number,
 count(*) FILTER (len(grams) > 0 AND list_max(list_transform(list_distinct(grams), lambda u: len(list_filter(grams, lambda v: v = u)))) >= 3) AS loop, count(*) FILTER (tp = '') AS empty FROM g GROUP BY split""")
def describe_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = systems(spark, sf_dir).withColumn("half", F.col("conv_id") % 2)
    return review.describe_system(rows, "half").withColumnRenamed("split", "split_more").withColumnRenamed("half", "split")


@query(rf"""WITH {_T}, m AS (SELECT len({_W('source')}) AS n, len({_W('prediction')}) AS p, len({_W('reference')}) AS ref FROM r)
SELECT CASE WHEN n < 60 THEN '0-60' WHEN n < 120 THEN '60-120' WHEN n < 250 THEN '120-250' ELSE '250-+' END AS source_words, count(*) AS rows,
 round(quantile_cont(p / greatest(n, 1), 0.5), 3) AS prediction_ratio, round(quantile_cont(ref / greatest(n, 1), 0.5), 3) AS reference_ratio FROM m GROUP BY 1""")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.length_buckets(systems(spark, sf_dir))


@query(rf"""WITH {_T} SELECT count(*) AS sources, count(*) FILTER (contains(prediction, ' of ')) AS says_lost, count(*) FILTER (contains(prediction, ' the ')) AS keeps, count(*) FILTER (contains(prediction, ' of ') AND NOT contains(prediction, ' the ')) AS lost_only,
 count(*) FILTER (NOT contains(prediction, ' of ') AND NOT contains(prediction, ' the ')) AS neither, count(*) FILTER (contains(reference, ' the ')) AS references_keep, count(*) FILTER (contains(reference, ' of ')) AS references_say_lost FROM r WHERE contains(source, ' the ')""")
def phrase_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.phrase_probe(systems(spark, sf_dir), " the ", " of ")


@query(rf"""WITH {_T}, m AS (SELECT regexp_matches({q.strip('source')}, '(the|de|of)\s*[.]\s*$') AS stub, len({_W('source')}) AS s, len({_W('reference')}) AS ref FROM r), e AS (SELECT *, stub AND ref >= 20 AND ref >= 3 * greatest(s, 1) AS grown FROM m)
SELECT count(*) FILTER (stub) AS stubs, round_even(100.0 * count(*) FILTER (stub) / greatest(count(*), 1), 2) AS stub_pct, count(*) FILTER (grown) AS expansions, round_even(100.0 * count(*) FILTER (grown) / greatest(count(*), 1), 2) AS expansion_pct,
 quantile_cont(s, 0.5) FILTER (grown) AS median_source_words, quantile_cont(ref, 0.5) FILTER (grown) AS median_reference_words FROM e""")
def pairing_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.pairing_probe(systems(spark, sf_dir), r"(the|de|of)\s*[.]\s*$")


@query(rf"""WITH {_T}, m AS (SELECT idx, {_W('source')} AS s, {_W('prediction')} AS p, len({_W('reference')}) AS ref, {q.strip('source')} = {q.strip('prediction')} AS same, {_Y('prediction')} AS py, {_Y('source')} AS sy FROM r),
c AS (SELECT idx, 'introduced_year' AS category FROM m WHERE len(list_filter(py, lambda x: NOT list_contains(sy, x))) > 0 UNION ALL SELECT idx, 'returned_source_unchanged' FROM m WHERE same
 UNION ALL SELECT idx, 'compressed_far_below_reference' FROM m WHERE len(p) < 0.5 * ref AND len(s) > 150
 UNION ALL SELECT idx, 'novel_content' FROM m WHERE len(list_filter(p, lambda x: length(x) > 3)) > 0 AND len(list_filter(p, lambda x: length(x) > 3 AND NOT list_contains(s, x))) / len(list_filter(p, lambda x: length(x) > 3)) > 0.4)
SELECT idx, category, rank FROM (SELECT idx, category, row_number() OVER (PARTITION BY category ORDER BY idx) AS rank FROM c) WHERE rank <= 5""")
def collected_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.collect_examples(systems(spark, sf_dir), 5).select("idx", "category", F.col("rank").cast("long").alias("rank"))


@query(rf"""WITH {_T}, x AS (SELECT 'source' AS side, source AS t FROM r UNION ALL SELECT 'reference', reference FROM r), m AS (SELECT side, len({_W('t')}) AS w, {_S('t')} AS s FROM x)
SELECT side, quantile_cont(w, 0.5) AS words_median, round_even(avg(w), 1) AS words_mean, quantile_cont(s, 0.5) AS sentences_median, round(quantile_cont(w / greatest(s, 1), 0.5), 2) AS words_per_sentence_median FROM m GROUP BY side""")
def corpus_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.corpus_shape(systems(spark, sf_dir))


@query(rf"""SELECT lang, round(avg(n), 6) AS mean, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, max(n) AS max FROM (SELECT lang, CAST(ceil(len({q.words('text')}) * 1.6) AS BIGINT) AS n FROM documents) GROUP BY lang""")
def token_length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosemill.functions.text import estimated_tokens

    rows = table(spark, sf_dir, "documents").select("lang", estimated_tokens(F.col("text")).alias("n"))
    return audit.token_lengths(rows, "n", "lang")


#: n-gram counts of source (s), candidate (c) and the one reference (t), as the operators make them.
_GRAMS = """, sides AS (SELECT idx, 's' AS side, string_split(lower(source), ' ') AS w FROM r UNION ALL SELECT idx, 'c', string_split(lower(prediction), ' ') FROM r UNION ALL SELECT idx, 't', string_split(lower(reference), ' ') FROM r),
grams AS (SELECT idx, side, n, unnest(list_transform(generate_series(1, greatest(len(w) - n + 1, 0)), lambda i: array_to_string(w[i:i+n-1], ' '))) AS gram FROM sides, (SELECT unnest([1, 2, 3, 4]) AS n)),
g AS (SELECT idx, n, gram, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 'c') AS c, count(*) FILTER (side = 't') AS t FROM grams GROUP BY ALL)"""
_PTB = lambda c: f"(CASE WHEN len({q.words(c)}) = 0 THEN 0 ELSE len(list_filter({q.words(c)}, lambda x: x IN ('.', '?', '!'))) + (CASE WHEN {q.words(c)}[-1] IN ('.', '?', '!') THEN 0 ELSE 1 END) END)"
_R = lambda a, b: f"(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END)"
_F1 = lambda p, r: f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"
_DSARI = f"""WITH {_T}{_GRAMS},
b AS (SELECT idx, n,
 {_R('coalesce(sum(CASE WHEN least(s, c) > 0 THEN least(s, c, t) / least(s, c) END), 0)', 'count(*) FILTER (least(s, c) > 0)')} AS kp,
 {_R('coalesce(sum(CASE WHEN least(s, t) > 0 THEN least(s, c, t) / least(s, t) END), 0)', 'count(*) FILTER (least(s, t) > 0)')} AS kr,
 {_R('coalesce(sum(CASE WHEN s > c THEN greatest(s - c - t, 0) / (s - c) END), 0)', 'count(*) FILTER (s > c)')} AS dp,
 {_R('count(*) FILTER (c > 0 AND s = 0 AND t > 0)', 'count(*) FILTER (c > 0 AND s = 0)')} AS ap, {_R('count(*) FILTER (c > 0 AND s = 0 AND t > 0)', 'count(*) FILTER (t > 0 AND s = 0)')} AS ar FROM g GROUP BY idx, n),
a AS (SELECT idx, sum({_F1('kp', 'kr')}) / 4 AS k, sum(dp) / 4 AS d, sum({_F1('ap', 'ar')}) / 4 AS a FROM b GROUP BY idx),
l AS (SELECT idx, len(string_split(lower(prediction), ' ')) AS o, len(string_split(lower(source), ' ')) AS i, len(string_split(lower(reference), ' ')) AS ref, {_PTB('lower(prediction)')} AS so, {_PTB('lower(reference)')} AS sr FROM r),
p AS (SELECT a.*, CASE WHEN o >= ref THEN 1.0 ELSE exp((o - ref) / greatest(o, 1)) END AS lp1, CASE WHEN o > ref THEN exp((ref - o) / greatest(i - ref, 1)) ELSE 1.0 END AS lp2, exp(-abs(sr - so) / greatest(sr, so, 1)) AS slp FROM a JOIN l USING (idx))"""


@query(_DSARI + " SELECT idx, round(k * lp2 * slp, 6) AS keep, round(d * lp2, 6) AS deletion, round(a * lp1, 6) AS addition, round((k * lp2 * slp + d * lp2 + a * lp1) / 3, 6) AS d_sari FROM p")
def document_sari(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.document_sari(scored(spark, sf_dir))
    return out.select("idx", *[F.round(c, 6).alias(c) for c in ("keep", "deletion", "addition", "d_sari")])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return systems(spark, sf_dir).select("idx", "conv_id", "source", F.col("prediction").alias("candidate"), F.array("reference").alias("references"))


@query(_DSARI + " SELECT round(100 * avg((k * lp2 * slp + d * lp2 + a * lp1) / 3), 6) AS d_sari, count(*) AS n FROM p")
def corpus_document_sari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.document_sari(scored(spark, sf_dir)).agg(F.round(100 * F.coalesce(F.avg("d_sari"), F.lit(0.0)), 6).alias("d_sari"), F.count("*").alias("n"))


@query(f"""WITH {_T}{_GRAMS}, b AS (SELECT n, sum(least(s, c, t)) AS kg, sum(least(s, c)) AS ks, sum(least(s, t)) AS kr, sum(greatest(greatest(s - c, 0) - t, 0)) AS dg, sum(greatest(s - c, 0)) AS ds,
 count(*) FILTER (c > 0 AND s = 0 AND t > 0) AS ag, count(*) FILTER (c > 0 AND s = 0) AS a_s, count(*) FILTER (t > 0 AND s = 0) AS ar FROM g GROUP BY n)
SELECT round(100 * sum(({_F1(_R('kg', 'ks'), _R('kg', 'kr'))} + {_R('dg', 'ds')} + {_F1(_R('ag', 'a_s'), _R('ag', 'ar'))}) / 3) / 4, 6) AS sari FROM b""")
def corpus_sari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.corpus_sari(scored(spark, sf_dir)).select(F.round("sari", 6).alias("sari"))


@query(f"""WITH {_T}, x AS (SELECT idx, 'c' AS side, string_split(prediction, ' ') AS w FROM r UNION ALL SELECT idx, 't', string_split(reference, ' ') FROM r),
e AS (SELECT idx, side, n, unnest(list_transform(generate_series(1, greatest(len(w) - n + 1, 0)), lambda i: array_to_string(w[i:i+n-1], ' '))) AS gram FROM x, (SELECT unnest([1, 2, 3, 4]) AS n)),
g AS (SELECT idx, n, gram, count(*) FILTER (side = 'c') AS c, count(*) FILTER (side = 't') AS t FROM e GROUP BY ALL), m AS (SELECT n, sum(least(c, t)) AS m, sum(c) AS k FROM g WHERE c > 0 GROUP BY n),
z AS (SELECT sum(len(string_split(prediction, ' '))) AS c, sum(len(string_split(reference, ' '))) AS ref FROM r)
SELECT round(CASE WHEN min(m) > 0 AND count(*) = 4 THEN 100 * (CASE WHEN any_value(z.c) >= any_value(ref) THEN 1.0 ELSE exp(1 - any_value(ref) / any_value(z.c)) END) * exp(sum(ln(m / k)) / 4) ELSE 0.0 END, 6) AS bleu FROM m, z""")
def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.corpus_bleu(scored(spark, sf_dir)).select(F.round("bleu", 6).alias("bleu"))


@query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-SARI of the stub against copies of the source, 1000 resamples of all rows."""
    rows = _evaluation_set(spark, sf_dir)
    a = metrics.document_sari(rows).select("idx", F.col("d_sari").alias("a"))
    b = metrics.document_sari(rows.withColumn("candidate", F.col("source"))).select("idx", F.col("d_sari").alias("b"))
    return metrics.paired_bootstrap(a.join(b, "idx"))


@query()
def paired_bootstrap_sari(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evaluation_set(spark, sf_dir)
    a = metrics.sari_statistics(rows, ["idx"])
    b = metrics.sari_statistics(rows.withColumn("candidate", F.col("source")), ["idx"])
    return metrics.paired_bootstrap_sari(a, b, rows.select("idx"))


def _evaluation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, each with an index of its own: turns may share a number."""
    from pyspark.sql import Window

    rows = scored(spark, sf_dir)
    order = Window.partitionBy("conv_id").orderBy("idx", "source", "references", "candidate")
    number = F.row_number().over(order)
    return rows.withColumn("idx", F.shiftleft(F.coalesce("conv_id", F.lit(-(2**30))).cast("long"), 32) + number)


@query("""SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, count(*) AS runs FROM events GROUP BY event_type""")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.seed_summary(table(spark, sf_dir, "events"), "event_type")
    return out.select("event_type", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "runs")
