"""URL rules and host reputation on small tables."""

import pytest

from dealscope.llm import op8_url_filter as op

CASES = [
    ("http://A.Com/x", "a.com", "/x", "com/", "allow"),
    ("https://com", "com", "", None, "allow"),
    ("https://com/", "com", "/", "com/", "allow"),
    ("http://example.com/en/", "example.com", "/en/", "example.com/en/", "block"),
    ("http://a.b.example.com/en/x?q#f", "a.b.example.com", "/en/x", "example.com/en/", "block"),
    ("http://www.example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://m.www.example.com/en/x", "m.www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/x", "notexample.com", "/en/x", "com/", "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net/fr/", "x.net", "/fr/", "net/fr/", "block"),
    ("http://x.net?u=http://b.com/c", "x.net", "", None, "block"),
    ("no scheme.com/en/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://h.org/p#x", "h.org", "/p", None, "allow"),
    ("a\nb://k.org/p", "k.org", "/p", None, "allow"),
]


def frame(spark, urls, more=()):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*urls, *more])], "page_id bigint, url string, host string, _n string")


def test_rules(spark):
    bad = ["http://x.net/es/1"] * 60 + ["http://g.com/a"] * 200
    got = {r.page_id: r for r in op.filter_urls(frame(spark, [c[0] for c in CASES], bad)).collect()}
    assert len(got) == len(CASES) + len(bad)
    for i, c in enumerate(CASES):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == c[1:], c


def test_given_outcomes_shrink(spark):
    urls = ["http://bad.org/a"] * 30 + ["http://good.org/a"] * 30 + ["http://new.org/a", "http://one.io/a"]
    outcomes = spark.createDataFrame([(i, int(i >= 30)) for i in range(60)] + [(61, 0)], "page_id bigint, outcome int")
    got = {r.page_id: r.verdict for r in op.filter_urls(frame(spark, urls), outcomes, rules=()).collect()}
    assert got[0] == "block" and got[30] == "allow"
    assert got[60] == "allow" and got[61] == "allow"  # unknown; one bad page is not enough


@pytest.mark.parametrize("urls", [[], ["http://a.org/"], [None]])
def test_small(spark, urls):
    assert [r.verdict for r in op.filter_urls(frame(spark, urls)).collect()] == ["allow"] * len(urls)
