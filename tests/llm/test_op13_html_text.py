"""Extraction against a plain merged tree, a regular expression on the given pages, and single pages."""

import math
import re
from collections import Counter, defaultdict
from html import unescape

import pytest

from dealscope.llm import op13_html_text as op

SCHEMA = "page_id bigint, url string, html string"


def text(page):
    return op.main_text(page, frozenset())[0]


@pytest.mark.parametrize("page, want", [
    ("", ""),
    ("no markup &amp; two  spaces", "no markup & two spaces"),
    ("<p>a<p>b<br>c<li>d", "a\nb c\nd"),
    ("<p><b>open<br><p>next</p>tail", "open\nnext\ntail"),
    ("<body><nav>menu</nav><article><h1>T&eacute;</h1><p>x &lt; y &#8212; &am &amp</p></article><footer>f</footer>", "Té\nx < y — &am &"),
    ("<header>site</header><main><header><h1>Title</h1></header><p>body</p><aside>side</aside></main>", "Title\nbody"),
    ("<div class='content'><p>one</p><div id=\"cookieNotice\">we use cookies</div><form><p>mail</p></form></div>", "one"),
    ("<article><p>text</p><section class=comments><article class=comment><p>nice</p></article></section></article>", "text"),
    ("<form id=aspnet><article><p>held by a form</p></article><input value=x></form>", "held by a form"),
    ("<script>var a = '</p><p>no';</script><style>p{}</style><p>yes</p><!-- <p>no</p> --><p hidden>no</p><p style='display: none'>no</p>", "yes"),
    ("<p>cut off <a href='x", "cut off"),
    ("<p>1 < 2 and 3 > 2</p><p title='a > b'>c</p>", "1 < 2 and 3 > 2\nc"),
    ("<table><tr><td>a<td>b<tr><td>c</table>after", "a\nb\nc\nafter"),
    ("<body class='has-sidebar'><div class=post><p>kept</p></div></body>", "kept"),
    ("<p>a</p><script>never closed", "a"),
    ("<P>Upper</P><DIV><SPAN>in</SPAN>line</DIV>", "Upper\ninline"),
    ("<p>a \t\n b　c</p>", "a b c"),
])
def test_single_pages(page, want):
    assert text(page) == want


def test_deep_and_long_pages():
    assert text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert len(text("<p>" + "word " * 400_000)) == 5 * 400_000 - 1


def site(n, host, start=0, low="<div class=x>Same line</div><div class=y2><p>Read this too</p><a href=/a>here</a></div>"):
    return [(start + i, f"https://{host}/p/{i}", f"<html><body>{low}<div class=z><p>Page {i} of {host}</p><p>Same words</p><p>and {i * i} more own words</p></div></body></html>")
            for i in range(n)]


def brute(pages, least=op.LEAST, min_pages=op.MIN_PAGES, roles=True):
    """One dictionary a host over all its pages, importance by the formulas on the counts."""
    host = lambda u: m[1].lower() if u and (m := re.match(r".*?://([^/?#]+)", u)) else None
    sites = defaultdict(list)
    for _, url, page in pages:
        if host(url) and page:
            sites[host(url)].append(page)
    low = {}
    for h, own in sites.items():
        of = defaultdict(lambda: (Counter(), Counter(), Counter()))
        up = {}
        for page in own:
            for path, parent, depth, kind, value in op.page_nodes(page):
                of[path][kind][value] += 1
                up[path] = parent, depth
        value, top = {}, {}
        for path in sorted(up, key=lambda p: -up[p][1]):
            styles, features, shown = of[path]
            m = shown[0]
            entropy = lambda k, n: 0 if m == 1 else -sum(x / n * math.log(x / n, m) for x in k)  # noqa: E731,B023
            if features:
                value[path] = 1.0 if m == 1 else 1 - sum(math.log(k, m) for k in features.values()) / len(features)
                top[path] = value[path]
                continue
            below = [p for p in up if up[p][0] == path and p in value]
            mean = sum(of[p][2][0] * value[p] for p in below) / sum(of[p][2][0] for p in below)
            fade = op.GAMMA ** len(styles)
            value[path] = (1 - fade) * (1.0 if m == 1 else min(1, entropy(styles.values(), sum(styles.values())))) + fade * mean
            top[path] = max([value[path], *(top[p] for p in below)])
        low[h] = frozenset(p for p in up if len(own) >= min_pages and top[p] < least and of[p][2][0] >= min_pages)
    return sorted((i, u, t, len(t)) for i, u, page in pages for t in [op.main_text(page or "", low.get(host(u), frozenset()), roles)[0]])


def test_against_brute_force_and_unnamed_boilerplate(spark):
    pages = site(9, "A.example.com") + site(3, "b.example.com", 100) + site(40, "c.example.org", 200, "<ul><li>x<li>y</ul>")
    pages += [(300, None, "<p>no url"), (301, "no-host", "<p>t"), (302, "https://a.example.com/q", None), (303, "http://a.example.com", ""), (5, *pages[5][1:])]
    got = sorted(tuple(r)[:4] for r in op.extract(spark.createDataFrame(pages, SCHEMA).repartition(3)).collect())
    want = brute([(i, u, h) for i, u, h in pages])
    assert [(i, t, n) for i, _, t, n in got if i < 300] == [(i, t, n) for i, _, t, n in want if i < 300]
    texts = {i: t for i, _, t, _ in got}
    assert texts[2] == "Page 2 of A.example.com\nSame words\nand 4 more own words"  # found by the tree alone
    assert texts[101].startswith("Same line\nRead this too\nhere\nPage 1")  # three pages are no evidence
    assert texts[207].startswith("Page 7 of c") and texts[300] == "no url" and texts[302] == "" == texts[303]


def test_given_pages(spark):
    """Article, blocks at p and h1: what the given pages consist of."""
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()]
    got = {r[0]: r[2] for r in op.op13_html_text(spark, "/root/testdata/sf0.001").collect()}
    for i, page in pages:
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert got[i] == "\n".join(x for x in parts if x)


def test_article_text_repeated_on_all_pages_stays(spark):
    pages = [(i, f"http://h.org/{i}", f"<nav>m</nav><article><h1>Same</h1><p>copy</p></article><p>own {i}</p>") for i in range(20)]
    assert {r[2] for r in op.extract(spark.createDataFrame(pages, SCHEMA)).collect()} == {"Same\ncopy"}
    pages = [(i, f"http://h.org/{i}", "<div class=a><p>copy of a text</p></div><div class=b>more</div>") for i in range(20)]
    assert {r[2] for r in op.extract(spark.createDataFrame(pages, SCHEMA)).collect()} == {"copy of a text"}


def test_empty_table_and_other_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "<p>x", "clash", 1.0)], SCHEMA + ", _host string, text double")
    assert [tuple(r)[:4] for r in op.extract(pages).collect()] == [(1, "http://a.b/c", "x", 1)]
    assert op.extract(pages.limit(0)).count() == 0
