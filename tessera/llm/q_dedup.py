"""Query of the near-duplicate operator."""

from pyspark.sql import functions as F

from . import common, neardup


def op5_near_duplicates(spark, sf_dir):
    """Every document with its class."""
    found = neardup.classes(common.table(spark, sf_dir, "documents"))
    return found.withColumn("is_first", F.col("doc_id") == F.col("class_id"))


QUERIES = {"op5_near_duplicates": op5_near_duplicates}
ORACLES = {}
