"""Chunk embeddings (S6) without a model: bags of words over buckets, unit length; summaries built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import text as tx
from . import measures, retrieval

DIM = 256


def sparse(chunks: DataFrame, dim: int = DIM) -> DataFrame:
    """(doc_id, idx, d, v): the coordinates of every chunk's embedding that aren't 0."""
    hit = chunks.select("doc_id", "idx", F.explode(tx.tokens(F.col("text"))).alias("t")).groupBy("doc_id", "idx", hashing.bucket(F.col("t"), dim).alias("d")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy("doc_id", "idx")))
    return hit.select("doc_id", "idx", "d", (F.col("c") / norm).alias("v"))


def dense(chunks: DataFrame, dim: int = DIM) -> DataFrame:
    """(doc_id, idx, vector array<double>)."""
    grouped = sparse(chunks, dim).groupBy("doc_id", "idx").agg(F.map_from_entries(F.collect_list(F.struct("d", "v"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.coalesce(F.element_at("m", d), F.lit(0.0)))
    return grouped.select("doc_id", "idx", full.alias("vector"))


def document_fit(chunks: DataFrame, dim: int = DIM) -> DataFrame:
    """(doc_id, ss2fd, qcs): cosine of the mean and the size-weighted mean of the chunks' vectors, and its ratio to ln(1 + words)."""
    n = chunks.select("doc_id", "idx", F.greatest(tx.n_words(F.col("text")), F.lit(1)).alias("n"))
    total = n.groupBy("doc_id").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("k"))
    by_dim = sparse(chunks, dim).join(n, ["doc_id", "idx"]).groupBy("doc_id", "d").agg(F.sum("v").alias("a"), F.sum(F.col("v") * F.col("n")).alias("b"))
    sums = by_dim.groupBy("doc_id").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    ss2fd = F.coalesce(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")), F.lit(0.0))
    return total.join(sums, "doc_id", "left").select("doc_id", ss2fd.alias("ss2fd"), tx.clip(ss2fd / F.ln(1.0 + F.col("words"))).alias("qcs"))


def document_scores(texts: list[str], dim: int = DIM, block: int = 64) -> Iterator[dict[int, float]]:
    """Of every chunk the cosines with the other ones that share a coordinate; a block of chunks is held against all at a time."""
    bucket = measures.buckets(dim).__getitem__
    held = np.fromiter((k * dim + bucket(t) for k, text in enumerate(texts) for t in measures.tokens(text)), np.int64)
    v = np.bincount(held, minlength=len(texts) * dim).reshape(-1, dim).astype(float)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    v = np.divide(v, norm, out=v, where=norm > 0)
    for at in range(0, len(texts), block):
        for q, row in enumerate(v[at : at + block] @ v.T, at):
            row[q] = 0.0
            some = np.flatnonzero(row)
            yield dict(zip(some.tolist(), row[some].tolist()))


def neighbour_scores(chunks: DataFrame, dim: int = DIM) -> DataFrame:
    """(doc_id, q, d, score): cosine of every two chunks of a document that share a coordinate; documents of three chunks or more."""
    return retrieval.score_rows(chunks, lambda texts: document_scores(texts, dim))
