"""The registered queries of the corpus operators: thin, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, fingerprint, html_text, line_dedup, near_dedup, quality, secret_scan, toxicity, warc
from ._shared import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file; FOLIOFRAME_VOCAB overrides the folder."""
    folder = os.environ.get("FOLIOFRAME_VOCAB")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), passages=True)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), keep_ids=False)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can express."""
    return op3_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column of op5 that SQL can express: what the ids decode to."""
    return op5_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality": op2_quality,
    "op3_fingerprints": op3_fingerprints,
    "op4_decontaminate": op4_decontaminate,
    "op5_bpe": op5_bpe,
    "op6_line_dedup": op6_line_dedup,
    "op7_secrets": op7_secrets,
    "op8_html": op8_html,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
    "fingerprint_edits": fingerprint_edits,
    "bpe_round_trip": bpe_round_trip,
}
_SHINGLES = r"""w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
 n AS (SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT x, y FROM p JOIN n u ON x = u.doc_id JOIN n v ON y = v.doc_id WHERE 100 * k >= 85 * (u.n + v.n - k)),
 e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l)"""
_BITS = "array_to_string(list_transform(range(20), lambda i: lpad(bin(CAST('0x' || substr(sha1(coalesce(html, '')), 2 * i + 1, 2) AS INTEGER)), 8, '0')), '')"
_BASE32 = f"array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5), lambda k: CAST(substr(bits, 5 * j + k + 1, 1) AS INTEGER) * CAST(power(2, 4 - k) AS INTEGER))) AS BIGINT), 1)), '')"



def _spans_sql(order: int, kind: str, pattern: str, group: int, least: int, base: bool) -> str:
    """Matches of one rule with their places: the lengths of the pieces between matches and of the matches add up."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {order} AS o, '{kind}' AS kind, {base} AS base, unnest(list_filter(list_transform(range(1, len(ms) + 1), lambda i: {{'s': list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0), 'n': length(ms[i]), 'g': length(gs[i])}}), lambda m: m.g >= {least})) AS m
 FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS gs, regexp_split_to_array(t, '{p}') AS ps FROM d)"""


_EITHER = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
_KINDS = [
    ("assign", f"""({_EITHER})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    ("access", "AKIA[A-Z0-9]+", 0, 20, True),
    ("hex", "[0-9a-f]+", 0, 24, True),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, False),
    ("hub_token", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, False),
    ("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, False),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0, False),
]
_ALL_SPANS = " UNION ALL ".join(_spans_sql(k, *rule) for k, rule in enumerate(_KINDS))

ORACLES: dict[str, str] = {
    # copies make few pairs at this size; the self-join is on shared shingles
    "op1_near_dedup": f"""WITH RECURSIVE {_SHINGLES}, r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, y FROM r JOIN e ON r.c = x)
 SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON n.doc_id = m.doc_id""",
    "op9_warc": f"""SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
 FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, {_BITS} AS bits, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)""",
    "op7_secrets": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({_ALL_SPANS}),
 j AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c, string_agg(kind || ':' || CAST(m.s AS BIGINT) || ':' || CAST(m.s + m.n AS BIGINT), ',' ORDER BY m.s, o) FILTER (base) AS bases, string_agg(kind || ':' || CAST(m.s AS BIGINT) || ':' || CAST(m.s + m.n AS BIGINT), ',' ORDER BY m.s, o) AS spans FROM f GROUP BY doc_id)
 SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(bases, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j ON d.doc_id = j.doc_id""",
    # the articles of these tables hold paragraphs, headings, bold type, line breaks and two character references
    "op8_html": r"""SELECT page_id, url, text, length(text) AS n_chars FROM (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(
   regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(p|h1)>', chr(1), 'g'), '<br>', ' ', 'g'), '&quot;', '"'), '</?b>', '', 'g'), '&amp;?', '&', 'g'), chr(1)),
   lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM pages)""",
    "fingerprint_edits": """SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(u, 1, length(t) // 2)) AS edited_sha256
 FROM (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS u FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""",
    "bpe_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
}
