"""Exports of chunks: CSV and Markdown rows, JSON documents, the explorer's filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preview(text: Column, chars: int = 120) -> Column:
    return F.replace(F.substr(text, F.lit(1), F.lit(chars)), F.lit("\n"), F.lit(" "))


def _column(chunks: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in chunks.columns else F.lit(None).cast(kind)


def entity_texts(chunks: DataFrame) -> Column:
    return F.coalesce(F.array_join("entities", ", "), F.lit("")) if "entities" in chunks.columns else F.lit("")


def csv_rows(chunks: DataFrame) -> DataFrame:
    """The eight columns of the export behind doc_id; what chunks(doc_id, idx, text, n_words, ...) lacks is null."""
    return chunks.select(
        "doc_id", F.col("idx").alias("index"), F.col("n_words").cast("long").alias("token_count"), *[_column(chunks, c, "double").alias(c) for c in ("chunk_score", "jsd_score", "boundary_score")],
        _column(chunks, "boundary_type", "string").alias("boundary_type"), entity_texts(chunks).alias("entities"), preview(F.col("text")).alias("text_preview"),
    )


def markdown(chunks: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown): what about(doc_id, type, domain) says, counts and the mean score, then every chunk behind a comment."""
    value = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    score = _column(chunks, "chunk_score", "double")
    comment = F.concat(F.lit("---\n<!-- chunk_index: "), F.col("idx"), F.lit(" | tokens: "), F.col("n_words"), F.lit(" | score: "), value(F.round(score, 4)), F.lit(" | entities: "), entity_texts(chunks), F.lit(" -->\n"), F.col("text"), F.lit("\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", comment.alias("t")))), lambda x: x["t"])
    found = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 4).alias("mean"), F.array_join(parts, "\n").alias("body"))
    j = found.join(about, "doc_id", "left") if about is not None else found.withColumns({"type": F.lit(None).cast("string"), "domain": F.lit(None).cast("string")})
    head = F.concat(F.lit("# Chunking results\n\n- Document type: "), value(F.col("type")), F.lit("\n- Domain: "), value(F.col("domain")), F.lit("\n- Chunks: "), F.col("n"), F.lit("\n- Mean score: "), value(F.col("mean")), F.lit("\n\n"))
    return j.select("doc_id", F.concat(head, "body").alias("markdown"))


def json_documents(chunks: DataFrame) -> DataFrame:
    """(doc_id, json): a document's chunks in order."""
    fields = [c for c in chunks.columns if c not in ("doc_id", "idx")]
    rows = F.array_sort(F.collect_list(F.struct("idx", *fields)))
    return chunks.groupBy("doc_id").agg(F.to_json(rows).alias("json"))


def explore(chunks: DataFrame, query: str = "", band: str | None = None, boundary_type: str | None = None) -> DataFrame:
    """Chunks whose text holds the query, in any case, whose score lies in the band (high from 0.75, medium from 0.5, low), and that have
    the boundary type."""
    found = chunks.filter(F.contains(F.lower("text"), F.lit(query.lower()))) if query else chunks
    found = found.filter(F.col("boundary_type") == boundary_type) if boundary_type else found
    kind = F.when(F.col("score") >= 0.75, "high").when(F.col("score") >= 0.5, "medium").otherwise("low")
    marked = found.withColumn("band", kind)
    return marked.filter(F.col("band") == band) if band else marked


def chunk_score(boundary: Column, icc: Column, jsd: Column) -> Column:
    """A chunk's score; a boundary score or coherence of 0 counts as unknown, 0.5."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(0.5))
    return 0.4 * (1.0 - known(boundary)) + 0.3 * known(icc) + 0.3 * F.least(jsd * 2.0, F.lit(1.0))
