"""Query of the HTML extraction."""

from . import common, extraction


def op8_html_text(spark, sf_dir):
    """The main text of every page."""
    return extraction.extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op8_html_text": op8_html_text}
ORACLES = {}
