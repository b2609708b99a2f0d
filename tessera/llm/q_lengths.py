"""Query of the token counts."""

from . import common, lengths


def op1_token_lengths(spark, sf_dir):
    """The histogram of encoded document lengths with its sums for every context limit."""
    return lengths.with_sums(lengths.histogram(common.table(spark, sf_dir, "documents")))


QUERIES = {"op1_token_lengths": op1_token_lengths}
ORACLES = {}
