"""Query of the benchmark decontamination."""

from . import common, decontaminate


def op3_decontaminate(spark, sf_dir):
    """Every document that overlaps with a benchmark item, once for each such item."""
    return decontaminate.overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES = {}
