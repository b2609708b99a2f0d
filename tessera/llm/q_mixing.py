"""Query and SQL of the mixing operator."""

from . import common, mixing


def op2_mixing(spark, sf_dir):
    """Every document with the words that the mix takes of it."""
    docs = common.table(spark, sf_dir, "documents")
    return mixing.copies(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS draw_key, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sums
), weighed AS (
  SELECT *, rank % 3 + 1 AS weight, source_size * 3 AS cap FROM ranked
), levels AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM sums) AS BIGINT)
     - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))::DOUBLE
     / CAST(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM weighed
), final AS (
  SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, rank LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE
     ELSE least(cap::DOUBLE, coalesce((SELECT level FROM final) * weight, cap::DOUBLE)) END AS target FROM levels
), rated AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets
), drawn AS (
  SELECT r.source, k.draw, CAST(sum(d.size * CAST(CAST('0x' || substr(md5(concat_ws('|', '7', CAST(k.draw AS VARCHAR), d.draw_key)), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE < r.rate - floor(r.rate) AS INTEGER)) AS BIGINT) AS words
  FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source, (SELECT unnest(range(64)) AS draw) k GROUP BY r.source, k.draw
), nearest AS (
  SELECT r.source, arg_min(w.draw, (abs(w.words - (r.target - floor(r.rate) * r.source_size)), w.draw)) AS draw
  FROM drawn w JOIN rated r ON w.source IS NOT DISTINCT FROM r.source GROUP BY r.source
), copied AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, CAST(floor(r.rate) AS INTEGER)
     + CAST(CAST('0x' || substr(md5(concat_ws('|', '7', CAST(n.draw AS VARCHAR), d.draw_key)), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE < r.rate - floor(r.rate) AS INTEGER) AS copies
  FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source JOIN nearest n ON n.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM copied
"""

QUERIES = {"op2_mixing": op2_mixing}
ORACLES = {"op2_mixing": OP2_SQL}
