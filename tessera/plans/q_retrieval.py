"""Queries of the retrieval metrics over windows of 100 words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval
from . import sql
from .catalog import register
from .q_signals import chunks, lists

_T = sql.strip("text")
_S = rf"string_split(regexp_replace({_T}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1]"
_L = f"string_split({_T}, chr(10))[1]"
SQL_FIRST = f"""CASE WHEN len({sql.words(_S)}) >= 6 THEN {_S} WHEN len({sql.words(_L)}) >= 6 THEN {_L}
  ELSE array_to_string({sql.words(_T)}[1 : CAST(greatest(6, floor(len({sql.words(_T)}) / 3)) AS BIGINT)], ' ') END"""


@register("first_sentence", f"WITH {sql.CHUNKS} SELECT doc_id, idx, {SQL_FIRST} AS query FROM chunks")
def first_sentence(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", "idx", retrieval.first_sentence(F.col("text")).alias("query"))


def _two(t: str) -> str:
    return f"list_filter({sql.tokens(t)}, lambda x: length(x) >= 2)"


SQL_BM25 = f"""held AS (SELECT doc_id, idx, count(*) OVER (PARTITION BY doc_id) AS n, {_two('text')} AS toks, {_two(SQL_FIRST)} AS ask FROM chunks),
h3 AS (SELECT *, len(toks) AS len, sum(len(toks)) OVER (PARTITION BY doc_id) AS total FROM held WHERE n >= 3),
post AS (SELECT doc_id, idx, term, count(*) AS tf FROM (SELECT doc_id, idx, unnest(toks) AS term FROM h3) GROUP BY ALL),
dfs AS (SELECT doc_id, term, count(*) AS df FROM post GROUP BY ALL),
asked AS (SELECT doc_id, idx AS q, term, count(*) AS qtf FROM (SELECT doc_id, idx, unnest(ask) AS term FROM h3) GROUP BY ALL),
bm AS (SELECT a.doc_id, a.q, p.idx AS d, round(sum(qtf * greatest(ln((h.n - 1 - (df - 1) + 0.5::DOUBLE) / (df - 1 + 0.5::DOUBLE)), 0.0::DOUBLE)
    * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * h.len / ((h.total - o.len) / (h.n - 1)::DOUBLE))))), 9) AS score
  FROM asked a JOIN post p ON a.doc_id = p.doc_id AND a.term = p.term AND a.q <> p.idx JOIN dfs f ON f.doc_id = a.doc_id AND f.term = a.term
  JOIN h3 h ON h.doc_id = p.doc_id AND h.idx = p.idx JOIN h3 o ON o.doc_id = a.doc_id AND o.idx = a.q GROUP BY ALL)"""


@register("bm25_loo", f"WITH {sql.CHUNKS}, {SQL_BM25} SELECT doc_id, q, d, score FROM bm")
def bm25_loo(spark, sf_dir):
    return retrieval.bm25_scores(lists(spark, sf_dir))


@register("retrieval_metrics", f"""WITH {sql.CHUNKS}, {SQL_BM25}, pairs AS (SELECT a.doc_id, a.idx AS q, b.idx AS d, a.n FROM h3 a JOIN h3 b ON a.doc_id = b.doc_id AND a.idx <> b.idx),
ranks AS (SELECT p.*, row_number() OVER (PARTITION BY p.doc_id, p.q ORDER BY coalesce(score, 0.0) DESC, p.d) AS r FROM pairs p LEFT JOIN bm USING (doc_id, q, d)),
each AS (SELECT doc_id, q, n, min(r) FILTER (WHERE abs(q - d) = 1) AS first, count(*) FILTER (WHERE abs(q - d) = 1) AS hits, coalesce(sum(1.0::DOUBLE / log2(r + 1)) FILTER (WHERE abs(q - d) = 1), 0.0::DOUBLE) AS dcg FROM ranks WHERE r <= 5 GROUP BY ALL)
SELECT doc_id, avg(coalesce(1.0::DOUBLE / first, 0.0::DOUBLE)) AS mrr, avg(dcg / CASE WHEN q = 0 OR q = n - 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE + 1.0::DOUBLE / log2(3) END) AS ndcg,
  avg(hits / 5.0::DOUBLE) AS precision, avg(hits::DOUBLE / CASE WHEN q = 0 OR q = n - 1 THEN 1 ELSE 2 END) AS recall, count(*) AS n_queries FROM each GROUP BY doc_id""")
def retrieval_metrics(spark, sf_dir):
    return retrieval.metrics_of_documents(lists(spark, sf_dir))
