"""Sliding windows of words over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def sliding_window(docs: DataFrame, size: int = 100, overlap: int = 0) -> DataFrame:
    """documents(doc_id, text) -> chunks(doc_id, idx, text, n_words): windows of `size` words, each beginning size - overlap words
    after the one before; the last ends with the document. Documents without a word have no chunk."""
    step = max(1, size - overlap)
    split = docs.select("doc_id", tx.words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    count = F.greatest(F.ceil((F.size("w") - size) / F.lit(step)), F.lit(0)) + 1
    placed = split.select("doc_id", "w", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("idx"))
    part = F.slice("w", F.col("idx") * step + 1, size)
    return placed.select("doc_id", "idx", F.array_join(part, " ").alias("text"), F.size(part).alias("n_words"))


def lists(docs: DataFrame, size: int = 100, overlap: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same chunks as a row a document, (doc_id, text, window, step, keep), for `measures`: texts are cut where they are measured."""
    return docs.select("doc_id", "text", F.lit(size).alias("window"), F.lit(max(1, size - overlap)).alias("step"), *keep)


def with_next(chunks: DataFrame) -> DataFrame:
    """Every chunk but a document's last, with its successor's text: (doc_id, idx, text, n_words, text_b)."""
    from pyspark.sql import Window

    return chunks.withColumn("text_b", F.lead("text").over(Window.partitionBy("doc_id").orderBy("idx"))).filter("text_b is not null")
