"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosemill.llm.ann_forest import nearest
from prosemill.llm.byte_bpe import encode_digests
from prosemill.llm.common import read
from prosemill.llm.html_text import extract_pages
from prosemill.llm.media import media_columns
from prosemill.llm.near_dedup import near_duplicates
from prosemill.llm.packing import packed
from prosemill.llm.secrets import find_secrets
from prosemill.llm.substring_dedup import repeated_passages
from prosemill.llm.toxicity import fit, score_toxicity, training_rows
from prosemill.llm.warc import archive_pages


def op1_zstd_novelty_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


def op2_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), n=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"), words=50, n=5, percent=80)


def op4_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), k=20)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"), capacity=1024)


def op6_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read(spark, sf_dir, "documents"), full=False)


def op8_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(training_rows(docs, read(spark, sf_dir, "labels"))))


def op9_text_to_tag_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read(spark, sf_dir, "documents"))


def op7_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read(spark, sf_dir, "pages"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 finds by the fixed patterns alone."""
    return op1_zstd_novelty_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 stores and reads back, without the features."""
    return op6_wav_fingerprints(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


QUERIES = {
    f.__name__: f
    for f in (
        op1_zstd_novelty_secrets,
        op2_superminhash_near_dedup,
        op3_compact_windows,
        op4_prefix_forest,
        op5_best_fit_packing,
        op6_wav_fingerprints,
        op7_zstd_warc,
        op8_zstd_toxicity,
        op9_text_to_tag_html,
        op10_byte_bpe,
        secret_base_spans,
        media_payloads,
    )
}

_HEX = "[0-9a-f]{24,}"
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, number: int, pattern: str, group: int) -> str:
    return f"""SELECT rn, {number} AS k, '{kind}' AS kind, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g FROM d"""


#: A digest's characters: five hexadecimal digits are four of them.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {shift}) & 31)::INT + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0)
)

#: The text of the test pages' blocks: links, bold and line breaks are inside, references are decoded.
_BLOCK = "regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '</?[ab](?: [^>]*)?>', '', 'g')"
for _name, _char in (("copy", "©"), ("middot", "·"), ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
    _BLOCK = f"replace({_BLOCK}, '&{_name};', '{_char}')"

#: SQL for what SQL can express; compressors, signatures and tokenizers have no counterpart. op9's is of
#: pages like those of the test tables, whose text is in one article of plain blocks.
ORACLES: dict[str, str] = {
    "secret_base_spans": f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_spans("assign", 0, _ASSIGN, 2)} UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", 0)} UNION ALL {_spans("hex", 2, _HEX, 0)}),
x AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
s AS (SELECT rn, k, kind, (list_sum(list_transform(p[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i-1], lambda v: length(v))), 0))::BIGINT AS a, length(m[i]) AS n
      FROM x WHERE length(g[i]) >= CASE k WHEN 0 THEN 6 WHEN 1 THEN 20 ELSE 24 END),
b AS (SELECT rn, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS j FROM s GROUP BY rn)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(j, '')) AS base_sha256 FROM d LEFT JOIN b USING (rn)""",
    "op2_superminhash_near_dedup": """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n + b.n - k)),
m AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT m.v, r.c FROM r JOIN m ON m.u = r.doc_id)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(c) AS component_id, min(c) = n.doc_id AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id""",
    "media_payloads": """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT *, octet_length(b) AS n FROM d),
p AS (SELECT *, greatest(64, (n + 63) // 64 * 64) AS size FROM n)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(from_hex(hex(b) || repeat('00', (size - n)::INT))) AS payload_sha256, size + 44 AS media_bytes FROM p""",
    "op9_text_to_tag_html": f"""WITH b AS (SELECT page_id, url, string_split_regex(split_part(split_part(coalesce(html, ''), '<article>', 2), '</article>', 1), '</?(?:p|h1|ul|li)>') AS b FROM pages),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(b, lambda b: trim(regexp_replace({_BLOCK}, '[\\s\\p{{Z}}]+', ' ', 'g'))), lambda x: x <> ''), ' ') AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t""",
    "op7_zstd_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS known FROM h)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = known THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> known THEN known END AS refers_to FROM k""",
}
