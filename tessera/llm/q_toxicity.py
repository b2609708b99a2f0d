"""Query of the toxicity operator."""

from pyspark.sql import functions as F

from . import common, toxicity

FOLDS = 5


def op4_toxicity(spark, sf_dir):
    """Every document's toxicity; the fold 0 of the ids is held out from learning."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels")
    net = toxicity.fit(docs, labels.filter(common.crc_mod(F.col("doc_id"), FOLDS) != 0))
    scored = toxicity.score(docs, net)
    return scored.select("doc_id", F.coalesce(common.crc_mod(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES = {}
