"""The registered queries of the text operators and their SQL checks."""

from __future__ import annotations

from cohortspan.llm import blocks, langid, linefreq, mixing, negatives, packing, pii, secrets, simhash, sketch, spelling, tokenfile, warc
from cohortspan.llm.common import documents, table
from cohortspan.plans.base import plain

QUERIES = {
    "op1_simhash_near_dedup": lambda spark, d: simhash.near_duplicates(documents(spark, d)),
    "op2_language_id": lambda spark, d: langid.identify(documents(spark, d)),
    "op3_token_file": lambda spark, d: tokenfile.round_trip(documents(spark, d)),
    "op4_mix_sources": lambda spark, d: plain(mixing.mix_report(documents(spark, d))),
    "op5_secret_scan": lambda spark, d: secrets.find_secrets(documents(spark, d)),
    "op6_pii": lambda spark, d: pii.find_pii(documents(spark, d)),
    "op7_fingerprints": lambda spark, d: sketch.with_edits(documents(spark, d)),
    "op8_exact_dedup": lambda spark, d: blocks.exact_duplicates(documents(spark, d)),
    "op9_line_dedup": lambda spark, d: linefreq.line_report(documents(spark, d)),
    "op10_best_fit_packing": lambda spark, d: packing.packed(documents(spark, d)),
    "op11_hard_negatives": lambda spark, d: negatives.mine(table(spark, d, "embeddings")),
    "op12_spelling_variants": lambda spark, d: spelling.spelling_variants(documents(spark, d)),
    "op13_warc": lambda spark, d: warc.round_trip(table(spark, d, "pages")),
}

SQL = {
    "op4_mix_sources": r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS ord
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight
  FROM docs GROUP BY source),
steps AS (
  SELECT *, 3 * source_size / weight AS ratio,
    ((SELECT sum(source_size) FROM sources) - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources WINDOW w AS (ORDER BY 3 * source_size / weight, source IS NULL, source)),
shared AS (SELECT arg_min(level, ratio) AS level FROM steps WHERE level <= ratio),
goals AS (
  SELECT s.source, s.source_size, CAST(least(3 * s.source_size, s.weight * shared.level) AS DOUBLE) AS target,
    CASE s.weight WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 ELSE 0.5 END AS w0, CASE s.weight WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 1.5 END AS w1
  FROM steps s, shared),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.w0, g.w1,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2 AS middle
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
uses AS (
  SELECT *, CASE WHEN size > 0
      THEN CAST(middle < target AS INTEGER) + CAST(source_size + middle < target AS INTEGER) + CAST(2 * source_size + middle < target AS INTEGER)
      ELSE CAST(middle < target OR source_size + middle < target OR 2 * source_size + middle < target AS INTEGER) END AS uses
  FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target, CAST(size * uses AS BIGINT) AS taken, uses,
  CASE WHEN uses > 0 THEN round(CASE WHEN middle = 0 THEN 0 ELSE
    2 * middle / (w0 * target + sqrt(w0 * target * w0 * target + 2 * (w1 - w0) * target * middle)) END, 6) END AS position
FROM uses""",
    "op8_exact_dedup": r"""
WITH docs AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
ranked AS (
  SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY body) AS group_size, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) AS place
  FROM docs)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM ranked""",
    "op9_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
bare AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS name FROM lines),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (
  SELECT b.source, b.name FROM (SELECT source, name, count(DISTINCT doc_id) AS pages FROM bare WHERE name <> '' GROUP BY source, name) b
  JOIN totals t ON t.source IS NOT DISTINCT FROM b.source WHERE pages >= 3 AND pages / total > 0.1),
marked AS (
  SELECT bare.*, bad.name IS NOT NULL AS dropped FROM bare LEFT JOIN bad ON bad.source IS NOT DISTINCT FROM bare.source AND bad.name = bare.name)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS text_sha256
FROM marked GROUP BY doc_id""",
    "op11_hard_negatives": r"""
WITH rows AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.q::DOUBLE[], c.q::DOUBLE[]) AS BIGINT) AS score
  FROM rows a JOIN rows c ON len(a.q) = len(c.q) AND a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS "rank",
  n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
WHERE 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY "rank" <= 10""",
    "op13_warc": r"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
ranked AS (
  SELECT page_id, body, first_value(page_id) OVER same AS head, row_number() OVER same AS place
  FROM payloads WINDOW same AS (PARTITION BY body ORDER BY page_id NULLS LAST)),
hexed AS (
  SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || sha1(body)[5 * i + 1:5 * i + 5] AS BIGINT)) AS fives FROM ranked)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
  array_to_string(list_transform(fives, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((v >> s) & 31) AS BIGINT), 1)), '')), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN head END AS refers_to
FROM hexed""",
}
