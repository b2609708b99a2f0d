"""Queries of the chunkers (S2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows
from . import sql
from .catalog import register
from .q_profile import docs


@register("sliding_chunks", f"WITH {sql.CHUNKS} SELECT doc_id, idx, md5(text) AS text_md5, n_words FROM chunks")
def sliding_chunks(spark, sf_dir):
    return windows.sliding_window(docs(spark, sf_dir)).select("doc_id", "idx", F.md5("text").alias("text_md5"), F.col("n_words").cast("long").alias("n_words"))


@register("sliding_overlap", rf"""WITH split AS (SELECT doc_id, {sql.words('text')} AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(ceil((len(w) - 120) / 90.0), 0) AS BIGINT) + 1)) AS i FROM split WHERE len(w) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS idx, md5(array_to_string(w[i * 90 + 1 : i * 90 + 120], ' ')) AS text_md5, len(w[i * 90 + 1 : i * 90 + 120]) AS n_words FROM placed""")
def sliding_overlap(spark, sf_dir):
    return windows.sliding_window(docs(spark, sf_dir), 120, 30).select("doc_id", "idx", F.md5("text").alias("text_md5"), F.col("n_words").cast("long").alias("n_words"))
