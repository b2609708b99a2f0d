"""Queries of the sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import measures, profile
from ..sources import readers, sinks
from . import sql
from .catalog import register
from .q_profile import SQL_TYPE, docs
from .q_signals import SQL_COMPOSITE, SQL_DIST, SQL_ICC, SQL_MULTI, SQL_PAIRS, SQL_THRESHOLDS, chunks, lists


#: Scored chunks: the boundary on a chunk's left (S4), coherence and the distance to the next chunk.
SQL_SCORED = f"""{SQL_DIST}, {SQL_ICC}, {SQL_PAIRS}, {SQL_MULTI}, {SQL_COMPOSITE}, {SQL_THRESHOLDS},
kinds AS (SELECT c.doc_id, c.idx, CASE WHEN d.jsd IS NULL THEN 'end' WHEN round(d.jsd, 9) > high THEN 'hard' WHEN round(d.jsd, 9) < low THEN 'merge' ELSE 'soft' END AS boundary_type
  FROM chunks c LEFT JOIN distances d USING (doc_id, idx) LEFT JOIN thresholds t ON c.doc_id = t.doc_id),
scored AS (SELECT c.doc_id, c.idx, c.text, c.n_words, coalesce(jsd, 0.0::DOUBLE) AS jsd, boundary_score, boundary_type, 0.4::DOUBLE * (1.0::DOUBLE - coalesce(nullif(boundary_score, 0.0::DOUBLE), 0.5::DOUBLE)) + 0.3::DOUBLE * coalesce(nullif(icc, 0.0::DOUBLE), 0.5::DOUBLE)
    + 0.3::DOUBLE * least(coalesce(jsd, 0.0::DOUBLE) * 2.0::DOUBLE, 1.0::DOUBLE) AS score
  FROM chunks c LEFT JOIN distances USING (doc_id, idx) LEFT JOIN iccs USING (doc_id, idx) LEFT JOIN composite USING (doc_id, idx) JOIN kinds USING (doc_id, idx))"""


def _scored(spark, sf_dir):
    j = measures.measure(lists(spark, sf_dir), ("text", "n_words", "jsd", "icc", "boundary_score", "boundary_type"))
    jsd = F.coalesce("jsd", F.lit(0.0))
    return j.select("doc_id", "idx", "text", "n_words", jsd.alias("jsd"), "boundary_score", "boundary_type", sinks.chunk_score(F.col("boundary_score"), F.col("icc"), jsd).alias("score"))


def _exported(spark, sf_dir):
    return _scored(spark, sf_dir).withColumns({"chunk_score": F.col("score"), "jsd_score": F.col("jsd")})


@register("export_csv", f"""WITH {sql.CHUNKS}, {SQL_SCORED} SELECT doc_id, idx AS index, n_words AS token_count, score AS chunk_score, jsd AS jsd_score, boundary_score, boundary_type, '' AS entities,
  replace(substr(text, 1, 120), chr(10), ' ') AS text_preview FROM scored""")
def export_csv(spark, sf_dir):
    return sinks.csv_rows(_exported(spark, sf_dir))


# The header's type stands in for both, since the oracle names no domain; scores are left out, whose last digits engines print differently.
@register("export_markdown", f"""WITH {sql.CHUNKS} SELECT doc_id, md5('# Chunking results' || chr(10) || chr(10) || '- Document type: ' || any_value(type) || chr(10) || '- Domain: None' || chr(10) || '- Chunks: ' || count(*) || chr(10) || '- Mean score: None' || chr(10) || chr(10) ||
  string_agg('---' || chr(10) || '<!-- chunk_index: ' || idx || ' | tokens: ' || n_words || ' | score: None | entities:  -->' || chr(10) || c.text || chr(10), chr(10) ORDER BY idx)) AS md
FROM chunks c JOIN (SELECT doc_id, {SQL_TYPE} AS type FROM documents) USING (doc_id) GROUP BY doc_id""")
def export_markdown(spark, sf_dir):
    about = docs(spark, sf_dir).select("doc_id", profile.doc_type(F.col("text")).alias("type"), F.lit(None).cast("string").alias("domain"))
    return sinks.markdown(chunks(spark, sf_dir), about).select("doc_id", F.md5("markdown").alias("md"))


@register("export_json", f"""WITH {sql.CHUNKS} SELECT doc_id, md5(string_agg(idx || ':' || n_words || ':' || text, chr(10) ORDER BY idx)) AS content FROM chunks GROUP BY doc_id""")
def export_json(spark, sf_dir):
    """The JSON of every document's chunks, read back."""
    rows = F.from_json("json", "array<struct<idx:int,n_words:int,text:string>>")
    lines = F.transform(rows, lambda r: F.concat_ws(":", r["idx"], r["n_words"], r["text"]))
    return sinks.json_documents(chunks(spark, sf_dir)).select("doc_id", F.md5(F.array_join(lines, "\n")).alias("content"))


@register("chunk_scores", f"WITH {sql.CHUNKS}, {SQL_SCORED} SELECT doc_id, idx, score FROM scored")
def chunk_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "idx", "score")


@register("explorer_filter", f"WITH {sql.CHUNKS}, {SQL_SCORED} SELECT doc_id, idx, 'medium' AS band FROM scored WHERE contains(lower(text), 'ation') AND boundary_type = 'soft' AND score >= 0.5 AND score < 0.75")
def explorer_filter(spark, sf_dir):
    return sinks.explore(_scored(spark, sf_dir), "Ation", "medium", "soft").select("doc_id", "idx", "band")


# The documents of a source stand for the pages of one document.
_L = sql.full_lines("text")


@register("repeated_lines", rf"""WITH src AS (SELECT source AS doc_id, doc_id AS page, text FROM documents),
edges AS (SELECT doc_id, page, unnest(list_distinct(CASE WHEN len(ls) <= 6 THEN ls ELSE ls[1:3] || ls[-3:] END)) AS line FROM (SELECT doc_id, page, {_L} AS ls FROM src)),
tot AS (SELECT doc_id, count(DISTINCT page) AS n FROM src GROUP BY doc_id)
SELECT doc_id, line FROM edges JOIN tot USING (doc_id) WHERE len({sql.words('line')}) <= 12 GROUP BY doc_id, line, n HAVING count(DISTINCT page) >= greatest(2.0, n * 0.1)""")
def repeated_lines(spark, sf_dir):
    pages = docs(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text")
    return readers.repeated_lines(pages, 0.1)


@register("page_numbers", rf"""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, {sql.q(readers.PAGE_NUMBER)})), chr(10)) AS text FROM documents""")
def page_numbers(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", readers.without_page_numbers(F.col("text")).alias("text"))
