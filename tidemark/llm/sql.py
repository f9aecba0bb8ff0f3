"""SQL of the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm.quality import BULLETS, STOP_WORDS

ORACLE: dict[str, str] = {}

ORACLE["op3_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, html, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM s
"""

ORACLE["op4_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_SPACE = r"[\x20\x09-\x0D]+"
_LINES = r"list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
ORACLE["op5_quality_rules"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (
  SELECT doc_id, sum(least(8, coalesce(i - before, 8))) AS n
  FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r) GROUP BY doc_id),
p AS (
  SELECT doc_id, max(n) AS n
  FROM (SELECT doc_id, pair, count(*) AS n
        FROM (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM d)
        GROUP BY 1, 2)
  GROUP BY 1),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len({_LINES}) AS BIGINT) AS n_lines,
         CAST(len({_LINES}) - len(list_distinct({_LINES})) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(regexp_extract_all(text, '(?m)^[ \t]*[{BULLETS}]')) AS n_bullets,
         len(regexp_extract_all(text, '(?m)([.][.][.]|…)[ \t\r]*$')) AS n_ellipses,
         len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_alphabetic,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop, coalesce(p.n, 0) AS top_pair
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN p ON d.doc_id = p.doc_id),
b AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_symbols * 5 <= n_words AND word_chars BETWEEN n_words * 2 AND n_words * 20
         AND n_dup_lines * 2 <= n_lines AND n_words >= n_lines * 2 AND n_bullets * 10 <= n_lines * 9
         AND n_ellipses * 10 <= n_lines * 3 AND n_alphabetic * 10 >= n_words * 6 AND (n_words < 100 OR n_stop > 0)
         AND top_pair * 5 <= n_words - 1 AS kept
FROM b
"""
