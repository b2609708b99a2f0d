"""Boundary signals between neighbouring chunks (S3): distribution distances, shared concepts, depth, drift, sentence entropy.

chunks(doc_id, idx, text), or packed, a row a document; the boundary idx lies between chunks idx and the next one. What is measured
between chunks is measured where their document is (`measures`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import measures

# Markers of the first line, and how deep they lie.
DEPTHS = (
    (r"^\s*(?:TITRE|CHAPITRE|BOOK|PART)\b", 1),
    (r"^\s*(?:SECTION|SOUS-SECTION)\b", 2),
    (r"^\s*(?:Article|Art\.?|§)\s*\d+", 3),
    (r"^\s*(?:\d+(?:\.\d+)+)\s+\S", 4),
    (r"^\s*[a-zA-Z]\.\s+\S", 5),
    (r"^\s*[-–•]\s+\S", 6),
)
# Weights of the hybrid signal.
HYBRID = {"jsd": 0.25, "hellinger": 0.20, "entropy_rate": 0.15, "pmi_drop": 0.20, "depth_change": 0.12, "drift": 0.08}


def distances(chunks: DataFrame) -> DataFrame:
    """(doc_id, idx, jsd, hellinger) of every boundary; 0.5 where a side has no token. JSD is in nats."""
    return measures.measure(chunks, ("jsd", "hellinger"), "next")


def pmi_drop(chunks: DataFrame, k: int = 8) -> DataFrame:
    """(doc_id, idx, pmi_drop): 1 minus the Jaccard similarity of the neighbours' top terms; 0.5 where a side has none."""
    return measures.measure(chunks, ("pmi_drop",), "next", top=k)


def depth_change(text_b: Column) -> Column:
    """How high in the document's outline the right chunk's first line stands; 0 without a marker."""
    first = F.coalesce(F.try_element_at(F.filter(F.transform(tx.lines(text_b), tx.strip), lambda x: x != ""), F.lit(1)), F.lit(""))
    out = F.lit(0.0)
    for pattern, depth in reversed(DEPTHS):
        out = F.when(first.rlike("(?iu)" + pattern), 1.0 - (depth - 1) / 6.0).otherwise(out)
    return out


def drift(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """(doc_id, idx, drift): 1 minus the cosine of the neighbours' bags of content tokens over buckets."""
    return measures.measure(chunks, ("drift",), "next", small=dim)


def entropy_rate(chunks: DataFrame) -> DataFrame:
    """(doc_id, idx, entropy_rate): mean JSD of successive sentences of both chunks together; 0 with fewer than two sentences."""
    return measures.measure(chunks, ("entropy_rate",), "next")


def features(chunks: DataFrame) -> DataFrame:
    """All six signals and the hybrid of every boundary."""
    return measures.measure(chunks, ("depth_change", "jsd", "hellinger", "pmi_drop", "drift", "entropy_rate", "hybrid"), "next")


def thresholds(signals: DataFrame, signal: str = "hybrid", low: float = 25, high: float = 75) -> DataFrame:
    """(doc_id, low, high): percentiles of a document's signal; high is moved 0.08 above low where they meet. Signals are compared
    by nine decimals, so that the order in which terms were summed decides nothing."""
    exact = F.round(F.col(signal), 9)
    found = signals.groupBy("doc_id").agg(F.percentile(exact, F.lit(low / 100)).alias("low"), F.percentile(exact, F.lit(high / 100)).alias("high"))
    return found.withColumn("high", F.when(F.col("low") >= F.col("high"), F.col("low") + 0.08).otherwise(F.col("high")))


def boundary_types(chunks: DataFrame, signals: DataFrame, signal: str = "hybrid") -> DataFrame:
    """(doc_id, idx, boundary_type) before merging: hard above the high threshold, merge below the low one, else soft; a
    document's last chunk ends it."""
    t = thresholds(signals, signal)
    exact = F.round(F.col(signal), 9)
    kind = F.when(exact > F.col("high"), "hard").when(exact < F.col("low"), "merge").otherwise("soft")
    marked = signals.join(t, "doc_id").select("doc_id", "idx", kind.alias("kind"))
    return chunks.select("doc_id", "idx").join(marked, ["doc_id", "idx"], "left").select("doc_id", "idx", F.coalesce("kind", F.lit("end")).alias("boundary_type"))
