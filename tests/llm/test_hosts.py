import pytest

from caseloom.llm import hosts
from caseloom.llm.queries import URL_RULES

CASES = [
    ("http://Blog.Example.COM/en/1", "blog.example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/2?x=1", "www.example.com", "/en/2", "www.example.com/en/", "allow"),
    ("https://a.com/x#y", "a.com", "/x", "com/", "allow"), ("http://a.com?x", "a.com", "", None, None),
    ("http://x.net/fr/3", "x.net", "/fr/3", "net/fr/", "block"), ("http://xnet/fr/3", "xnet", "/fr/3", None, None),
    ("http://net/es/", "net", "/es/", "net/es/", "block"), ("nothing", "", "", None, None), (None, "", "", None, None),
    ("", "", "", None, None), ("a://b://c", "b:", "//c", None, None), ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(CASES)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r.page_id: r for r in hosts.judge(pages, none, URL_RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        assert (rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) == (host, path, rule, verdict or "allow")
    assert hosts.judge(pages.limit(0), none, URL_RULES).collect() == []


def test_posterior(spark):
    """A host with many bad pages is blocked, one with a single bad page is shrunk to its domain."""
    rows = [("bad.evil.org", 1)] * 40 + [("one.good.org", 1)] + [(f"h{i}.good.org", 0) for i in range(60)] * 3
    rows += [("new.evil.org", None)]
    got = {r.host: r for r in hosts.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.evil.org"].low > 0.8 and got["one.good.org"].low < 0.5
    assert got["h1.good.org"].mean < got["one.good.org"].mean < got["bad.evil.org"].mean
    assert got["new.evil.org"].n == 0 and got["new.evil.org"].mean > got["h1.good.org"].mean


@pytest.mark.parametrize("labels", [[(1, None, None), (None, 1, 1), (1, 0, 0)], []])
def test_null_labels(spark, labels):
    pages = spark.createDataFrame([(1, "http://a.org/en/1"), (None, "http://a.org/en/1"), (1, "http://a.org/en/1")],
                                  "page_id long, url string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert hosts.judge(pages, table, []).count() == 3
