"""URL propagation doesn't depend on seed hosts without links, nor on the length of a chain."""

from pairlytics.llm import url_filter

LINK = '<a href="http://{}/p">t</a>'


def judged(spark, pages):
    return {r["host"]: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_large_unlinked_seed(spark):
    chain = [(1, "http://bad.net/es/", ""), (2, "http://a.org/", LINK.format("bad.net")), (3, "http://b.org/", LINK.format("a.org"))]
    far = chain + [(10 + i, "http://alone.net/es/", "") for i in range(10_000)]
    for pages in (chain, far):
        got = judged(spark, pages)
        assert got["b.org"]["distrust"] > 0 and got["b.org"]["verdict"] == "block"
