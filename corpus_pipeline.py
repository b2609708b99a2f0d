"""The corpus pipeline: quality rules, toxicity, near-duplicates, benchmark decontamination, mixing to target weights.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the shared folder and reads them
back as the next one's documents. All but the last return the columns of `documents`; other columns of docs, whatever their names, are dropped.
Every stage gives an empty table for an empty one, reads texts whole, and treats repeated rows alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, mixing, neardup, quality, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others keep their text without the failing lines, and n_chars is counted anew. Null and empty
    texts are rejected; a null id, lang or source changes nothing."""
    judged = quality.apply_rules(docs.select(*COLUMNS)).filter("kept")
    cleaned = judged.withColumn("text", F.col("cleaned"))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the model learns from all labels of the documents at hand. An id with both labels teaches as
    toxic, labels without an id or of absent documents don't teach; with labels of one kind or none every text, as null and empty texts
    always, scores the share of toxic labels."""
    net = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), net, least=0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the least id, rows without an id last, then by the md5 of the text. Of repeated rows
    one stays, and rows of one id are one document; texts without words all stay."""
    return neardup.deduplicate(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; null and empty texts and items overlap with nothing."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy that the mix takes, numbered in copy_index. Null is a source of its own, the last; repeated rows are taken
    equally often, rows without an id by their text."""
    return mixing.mix(docs.select(*COLUMNS))


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The toxicity model and the sampled near-duplicate search aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, name.replace(" ", "-"))
    return docs
