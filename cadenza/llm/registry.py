"""The corpus operators' queries, by name, and SQL twins where SQL can say it."""

from __future__ import annotations

from .html_text import op5_composite_text_density
from .itq import op10_itq_near_dedup
from .lm import op11_kneser_ney_scores
from .packing import op2_concat_and_cut
from .pieces import op8_sentencepiece_viterbi
from .pii import op1_pii_surrogates
from .quality import op3_line_crf_quality
from .runs import op13_kolpakov_kucherov
from .secrets import op4_secret_scan
from .simhash import op7_simhash_near_dedup
from .suffix_dedup import op6_suffix_levels
from .token_alignment import op12_segment_alignment
from .warc import op9_warc_round_trip

OP9_SQL = """
WITH p AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS h FROM p
), b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(CAST(strpos('123456789abcdef', substr(h, i, 1)) AS INTEGER)), 4, '0')), '') AS bits,
         min(page_id) OVER (PARTITION BY h) AS lead
  FROM d
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, 5 * k + j + 1, 1) AS INTEGER) * (16 >> j))) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN lead IS NULL OR page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN lead IS NULL OR page_id = lead THEN NULL ELSE lead END AS refers_to
FROM b
"""

#: Every 200-byte string, as hexadecimal digits, counted over all documents.
OP6_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, CAST(doc_id AS BIGINT) AS doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT rid, o, substr(h, 2 * o + 1, 1398) AS h FROM (SELECT rid, h, unnest(range(0, greatest(0, length(h) // 2 - 199), 500)) AS o FROM d)
), w AS MATERIALIZED (
  SELECT rid, o + i AS s, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT rid, o, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM c)
), r AS (
  SELECT rid, s FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)
), e AS (
  SELECT rid, s, CASE WHEN s <= lag(s) OVER (PARTITION BY rid ORDER BY s) + 200 THEN 0 ELSE 1 END AS fresh FROM r
), g AS (
  SELECT rid, s, sum(fresh) OVER (PARTITION BY rid ORDER BY s) AS island FROM e
), span AS (
  SELECT rid, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY rid, island
), cut AS (
  SELECT rid, a, b FROM span UNION ALL SELECT rid, length(h) // 2, NULL FROM d
), part AS (
  SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a, b NULLS LAST), 0) AS a, a AS b FROM cut
), kept AS (
  SELECT rid, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM part JOIN d USING (rid) GROUP BY rid
), total AS (
  SELECT rid, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY rid
)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (rid) LEFT JOIN total USING (rid)
"""

#: All pairs, in double precision.
OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS MATERIALIZED (
  SELECT rid, vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), l AS MATERIALIZED (
  SELECT a.rid AS a, b.rid AS b FROM u a JOIN u b ON a.rid <> b.rid AND list_dot_product(a.e, b.e) >= 0.9
), reach AS (
  SELECT rid AS a, rid AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b
), c AS (
  SELECT reach.a AS rid, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.b GROUP BY reach.a
), n AS (
  SELECT a AS rid, count(*) AS n_links FROM l GROUP BY a
)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(v.vec_id = component_id, false) AS kept
FROM v JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


def queries():
    return {
        "op1_pii_surrogates": op1_pii_surrogates,
        "op2_concat_and_cut": op2_concat_and_cut,
        "op3_line_crf_quality": op3_line_crf_quality,
        "op4_secret_scan": op4_secret_scan,
        "op5_composite_text_density": op5_composite_text_density,
        "op6_suffix_levels": op6_suffix_levels,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_sentencepiece_viterbi": op8_sentencepiece_viterbi,
        "op9_warc_round_trip": op9_warc_round_trip,
        "op10_itq_near_dedup": op10_itq_near_dedup,
        "op11_kneser_ney_scores": op11_kneser_ney_scores,
        "op12_segment_alignment": op12_segment_alignment,
        "op13_kolpakov_kucherov": op13_kolpakov_kucherov,
    }


def oracle_sql():
    return {"op6_suffix_levels": OP6_SQL, "op9_warc_round_trip": OP9_SQL, "op10_itq_near_dedup": OP10_SQL}
