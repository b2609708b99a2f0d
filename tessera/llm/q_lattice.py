"""Query of the lattice language model."""

from pyspark.sql import functions as F

from . import common, lattice


def op10_lattice_score(spark, sf_dir):
    """Every document's base and lattice log10 probability."""
    docs = common.table(spark, sf_dir, "documents")
    return lattice.score(docs, F.coalesce(common.crc_mod(F.col("doc_id"), 7) == 2, F.lit(False)))


QUERIES = {"op10_lattice_score": op10_lattice_score}
ORACLES = {}
