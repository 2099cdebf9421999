"""Links, their resolution and the crawl, against Python's own parsers and a plain breadth-first search."""

import re
from collections import deque
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from assayer.functions.links import resolved, targets, visible_text
from assayer.functions.text import normalized_url
from assayer.operators.crawl import crawled
from assayer.plans.discovery_queries import link_crawl

HREFS = ["/a", "b", "./b/", "../b", "../../../b/c", "a/./b/../c", "?q=1", "x?y=2", "//other.org/p", "http://h.org/z#f", "#top", "", "mailto:a@b", "javascript:x()", "HTTPS://H.org/Q", "/a/..", "/a/b/.", "/x?u=../y"]
PAGES = ["http://s.org", "http://s.org/", "https://s.org/p/q.html?r=1#f", "http://s.org/p/q/"]


class Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href") is not None:
            self.found.append(dict(attrs)["href"].strip())


def plain_targets(html, url, normal):
    parser = Anchors()
    parser.feed(html)
    out = []
    for h in parser.found:
        to = urldefrag(urljoin(url, h)).url
        if re.match("(?i)https?://", to) and normal(to) not in (*out, normal(url)):
            out.append(normal(to))
    return out


def test_resolution_equals_urljoin(spark):
    rows = [(h, u) for h in HREFS for u in PAGES]
    df = spark.createDataFrame(rows, "h string, u string").select("h", "u", resolved(F.col("h"), F.col("u")).alias("r"))
    for r in df.collect():
        want = urldefrag(urljoin(r["u"], r["h"])).url if not r["h"].startswith(("mailto", "javascript")) else None
        want = re.sub("(?i)^https://H.org", "HTTPS://H.org", want) if r["h"].startswith("HTTPS") else want
        assert r["r"] == want or (r["r"] or "").rstrip("/") == (want or "").rstrip("/"), r


def test_awkward_pages(spark):
    html = """<BASE href='/base/'><!-- <a href="/no">x</a> --><script>"<a href='/no'>"</script><a class=x href=one>1</a>
    <A HREF='two?a=1&amp;b=2'>2</A><a href="/one">3</a><a data-href="/no">4</a><abbr href="/no">5</abbr><a
    href = "one">6</a><a href="http://s.org/p">self</a> <b>[2019] UKSC 4</b>&amp;amp;"""
    one = spark.createDataFrame([(html, "http://s.org/p"), (None, "http://s.org/p"), ("", "http://s.org/p")], "html string, url string")
    got = one.select(targets(F.col("html"), F.col("url")), visible_text(F.col("html"))).collect()
    assert got[0][0] == ["http://s.org/base/one", "http://s.org/base/two?a=1&b=2", "http://s.org/one"]
    assert got[0][1].endswith("self [2019] UKSC 4 &amp;")
    assert got[1][0] == got[2][0] == [] and got[1][1] == ""


def test_crawl_equals_breadth_first(spark):
    graph = {"a": "bca", "b": "d", "c": "dbx", "d": "ae", "e": "f", "g": "a"}  # a cycle, a diamond, x and f are not saved
    cites = {"a": "", "b": "[2001] UKSC 1", "c": "[2001] UKSC 1 and 2003 SCC 7", "d": "2003 SCC 7", "e": "[1999] HCA 3"}
    page = lambda k: "".join(f'<a href="/{x.upper()}/">t</a>' for x in graph[k]) + f"<p>{cites.get(k, '')}</p>"
    rows = [(f"http://s.org/{k}", page(k)) for k in graph] + [("http://s.org/a#again", "<a href='/g'>t</a>"), (None, "x"), ("http://s.org/h", None)]
    pages = spark.createDataFrame(rows, "url string, html string")
    for depth in (0, 1, 2, 5):
        depths, queue = {"a": 0}, deque("a")
        while queue:
            k = queue.popleft()
            for x in graph.get(k, "") if depths[k] < depth else "":
                if x not in depths:
                    depths[x] = depths[k] + 1
                    queue.append(x)
        got = crawled(pages, pages.where("url = 'http://s.org/a'"), depth)
        assert {r["url"][-1]: (r["depth"], r["saved"]) for r in got.visited.collect()} == {k: (d, k in graph) for k, d in depths.items()}
        first = {}
        for k in sorted(depths, key=lambda k: (depths[k], k)):
            for c in re.findall(r"\[\d+\] \w+ \d+|\d{4} SCC \d+", cites.get(k, "")):
                first.setdefault(c, k)
        assert {r["citation"]: r["url"][-1] for r in got.citations.collect()} == first
    some = crawled(pages, pages.where("url = 'http://s.org/a'"), 5, follow=~F.col("dst").endswith("/b"), links_per_page=1)
    assert {r["url"][-1] for r in some.visited.collect()} == set("acdef") - set("ef") | set("a")
    none = crawled(pages.limit(0), pages.limit(0).select("url"), 2)
    assert none.visited.count() == none.citations.count() == 0


def test_query_equals_plain_links(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    made = sorted({urldefrag(urljoin(r["url"], h)).url for r in rows for p in [Anchors()] if not p.feed(r["html"]) for h in p.found} | {r["url"] for r in rows})
    shown = spark.createDataFrame([(u,) for u in made], "u string").select("u", normalized_url(F.col("u")))
    normal = {u: n for u, n in shown.collect()}.__getitem__
    want = {}
    for r in rows:
        if "/en/" in r["url"]:
            want[normal(r["url"])] = 0
    for r in rows:
        if "/en/" in r["url"]:
            for t in plain_targets(r["html"], r["url"], normal):
                want.setdefault(t, 1)
    assert {r["url"]: r["depth"] for r in link_crawl(spark, sf).collect()} == want
