"""Query and SQL of the quality rules."""

from . import common, quality


def op9_quality_rules(spark, sf_dir):
    """Statistics and verdict for every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.apply_rules(docs, cleaned=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed_lines", "lost_chars")


def _sql(s: str) -> str:
    return s.replace("'", "''")


OP9_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), placed AS (
  SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words
), windows AS (
  SELECT rid, pos, word, lead(word, 1) OVER x AS w2, lead(word, 2) OVER x AS w3 FROM placed WINDOW x AS (PARTITION BY rid ORDER BY pos)
), again AS (
  SELECT rid, pos FROM windows WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, word, w2, w3) > 1
), covered AS (
  SELECT rid, count(DISTINCT pos + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS t(k) GROUP BY rid
), lines AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs
), full_lines AS (
  SELECT rid, line, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n_words, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
     row_number() OVER (PARTITION BY rid, line ORDER BY pos) > 1 AS dup
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), judged AS (
  SELECT *, regexp_matches(line, '{_sql(quality.BOILERPLATE)}')
     OR (len(regexp_extract_all(regexp_replace(line, '([ \t])', '\1\1', 'g'), '{quality.SEPARATOR}')) >= 3
         AND 4 * len(regexp_extract_all(regexp_replace(line, '([ \t])', '\1\1', 'g'), '{quality.SEPARATOR}')) >= n_words)
     OR 2 * len(regexp_extract_all(line, '{quality.SYMBOLS}')) > n_words
     OR (n_words >= 5 AND 2 * len(regexp_extract_all(line, '{quality.UPPER}')) > chars)
     OR dup
     OR (n_words < 20 AND NOT regexp_matches(line, '{_sql(quality.CLOSED)}')) AS fault
  FROM full_lines
), by_line AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE dup) AS n_dup_lines, count(*) FILTER (WHERE fault) AS n_removed_lines,
     CAST(coalesce(sum(chars) FILTER (WHERE fault), 0) AS BIGINT) AS lost_chars
  FROM judged GROUP BY rid
), base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
     CAST(len(regexp_extract_all(text, '{quality.SYMBOLS}')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
     coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(lost_chars, 0) AS lost_chars
  FROM docs JOIN words USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN by_line USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept
FROM base
"""

QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES = {"op9_quality_rules": OP9_SQL}
