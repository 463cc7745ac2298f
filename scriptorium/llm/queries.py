"""The registered queries opN_<name> and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import exactdup, htmltext, imatch, licenses, mixing, neardup, pieces, quality, secrets, toxicity
from scriptorium.llm._common import table


def op1_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op3_rare_token_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("places")


def op4_keyword_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_subsequence_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), limit=3)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_stream_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(table(spark, sf_dir, "documents")).drop("file", "place")


def op10_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.encode(table(spark, sf_dir, "documents"), k=2))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        op1_ftrl_quality,
        op2_imatch_fingerprints,
        op3_rare_token_licenses,
        op4_keyword_secrets,
        op5_minhash_neardup,
        op6_crf_toxicity,
        op7_subsequence_html,
        op8_entropy_mix,
        op9_stream_exact_dedup,
        op10_gumbel_pieces,
    )
}

ORACLES: dict[str, str] = {
    "op2_imatch_fingerprints": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS k, count(*) OVER () AS n FROM documents),
pairs AS (
  SELECT a.doc_id, a.k, a.n, a.t, length(a.t) AS c, b.t AS u FROM d a JOIN d b ON b.k = a.k % a.n + 1),
both_texts AS (
  SELECT doc_id, k, n, c, 0 AS kind, t AS x FROM pairs
  UNION ALL SELECT doc_id, k, n, c, 1, left(t, CAST(c - c // 2 AS BIGINT)) || left(u, CAST(c // 2 AS BIGINT)) FROM pairs),
worded AS (
  SELECT *, list_distinct(regexp_extract_all(lower(x), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM both_texts),
flat AS (SELECT k, kind, n, unnest(w) AS term FROM worded),
band AS (
  SELECT term, md5(term) AS h FROM flat WHERE kind = 0 GROUP BY term, n HAVING count(*) >= 0.002 * n AND count(*) <= 0.1 * n),
subsets AS (
  SELECT * FROM (VALUES (0, '80'), (1, '80'), (2, '40'), (3, '40'), (4, '10'), (5, '10'), (6, '10'), (7, '10'), (8, '04'), (9, '04'), (10, '04'), (11, '04'), (12, '04'), (13, '04'), (14, '04'), (15, '04')) s(j, bound)),
member AS (
  SELECT f.k, f.kind, s.j, f.term FROM flat f JOIN band b USING (term) JOIN subsets s ON substr(b.h, CAST(2 * s.j + 1 AS BIGINT), 2) < s.bound),
part AS (SELECT k, kind, j, left(md5(string_agg(term, ' ' ORDER BY term)), 8) AS c FROM member GROUP BY k, kind, j),
has AS (SELECT DISTINCT k, kind FROM member),
full_parts AS (
  SELECT w.k, w.kind, s.j, CASE WHEN h.k IS NULL THEN left(md5(lower(w.x)), 8) ELSE coalesce(p.c, '--------') END AS c
  FROM worded w CROSS JOIN subsets s LEFT JOIN has h ON h.k = w.k AND h.kind = w.kind LEFT JOIN part p ON p.k = w.k AND p.kind = w.kind AND p.j = s.j),
fp AS (SELECT k, kind, string_agg(c, '' ORDER BY j) AS f FROM full_parts GROUP BY k, kind),
near AS (
  SELECT a.k, b.kind, CAST(count(*) FILTER (WHERE a.c = b.c AND a.c <> '--------') AS DOUBLE) / count(*) FILTER (WHERE a.c <> '--------' OR b.c <> '--------') AS v
  FROM full_parts a JOIN pairs p ON p.k = a.k
  JOIN full_parts b ON b.j = a.j AND ((b.k = a.k AND b.kind = 1) OR (b.k = p.k % p.n + 1 AND b.kind = 0)) WHERE a.kind = 0 GROUP BY a.k, b.kind)
SELECT e.doc_id, CAST(e.c AS BIGINT) AS n_chars, sha256(e.x) AS edited_sha256, o.f AS fingerprint, m.f AS edited_fingerprint, ne.v AS near_edited, nn.v AS near_next
FROM both_texts e JOIN fp o ON o.k = e.k AND o.kind = 0 JOIN fp m ON m.k = e.k AND m.kind = 1
JOIN near ne ON ne.k = e.k AND ne.kind = 1 JOIN near nn ON nn.k = e.k AND nn.kind = 0 WHERE e.kind = 1
""",
    "op5_minhash_neardup": r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s
  FROM worded),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS v, doc_id AS r FROM sets
  UNION
  SELECT e.b, reach.r FROM reach JOIN both_ways e ON e.a = reach.v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM sets s JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) m ON m.v = s.doc_id
""",
    "op8_entropy_mix": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS o
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM sized GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM totals),
filled AS (
  SELECT *, CAST(sum(total) OVER () - coalesce(sum(3 * total) OVER p, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS DOUBLE) AS level,
    row_number() OVER (ORDER BY CAST(total AS DOUBLE) / w, w) AS k
  FROM weighed WINDOW p AS (ORDER BY CAST(total AS DOUBLE) / w, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT level FROM filled WHERE w * level <= 3 * total ORDER BY k LIMIT 1),
goals AS (SELECT f.source, f.total, CASE WHEN f.w * c.level > 3 * f.total THEN CAST(3 * f.total AS DOUBLE) ELSE f.w * c.level END AS target FROM filled f, chosen c),
parts AS (SELECT *, CASE WHEN total > 0 THEN CAST(floor(target / total) AS BIGINT) ELSE 0 END AS base FROM goals),
placed AS (
  SELECT s.*, p.total, p.target, p.base, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size / 2.0 AS middle
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, total AS source_size, target,
  CAST(size * (CASE WHEN total > 0 THEN base + CASE WHEN middle <= target - base * total THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS taken
FROM placed
""",
    "op9_stream_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
""",
}
