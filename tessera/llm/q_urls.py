"""Query of the URL filter."""

from . import common, urls


def op6_url_filter(spark, sf_dir):
    """The verdict on every page's url."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict", "difference", "threshold")


QUERIES = {"op6_url_filter": op6_url_filter}
ORACLES = {}
