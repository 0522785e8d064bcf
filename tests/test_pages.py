"""Page reports against Python's own HTML parser, and on hand-made pages."""

import random
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagetally.functions import html, urls
from pagetally.operators import pages as reports

PAGES_SCHEMA = "page_id bigint, url string, html string"


def pages_df(spark, texts, url="https://a.example/x"):
    rows = [(i, url, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, PAGES_SCHEMA)


class Audit(HTMLParser):
    def __init__(self, text):
        super().__init__(convert_charrefs=False)
        self.counts, self.hrefs, self.meta = Counter(), [], False
        self.titles, self.in_title = [], False
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        first = {}
        for name, value in attrs:
            first.setdefault(name, value)
        self.counts[tag] += 1
        if tag == "a" and first.get("href") is not None:
            self.hrefs.append(self.get_starttag_text() and first["href"])
        if tag == "meta" and (first.get("name") or "").strip().lower() == "description":
            self.meta = True
        if tag == "title":
            self.titles.append("")
            self.in_title = True

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.titles[-1] += data

    def title(self):
        return " ".join(self.titles[0].split()) if self.titles else ""


PIECES = [
    "<!DOCTYPE html>", "<p>", "<br/>", "text", "a < b", "1<2", "</p>", "<abbr>", "<h1>", "<H1 id=x>",
    "<h1\n>", "</h1>", "<h10>", "<hr>", '<img src="x>y">', "<IMG alt='<a href=no>'>", "<img/>",
    '<a href="/one">', "<A HREF='/two'>", "<a href=/three>", '<a\n\thref = "/four" >', "<a>", "<a name=x>",
    '<a title="href=\'no\'" href="/five">', '<a data-href="no">', "<a x href=/six y='1'>",
    '<a href="/seven" href="no">', '<a href="">', "<a title='a > b' href='/eight'>", "</a>",
    "<!-- <a href=no> <h1> -->", "<!-- > <img> -->", "<!---->",
    '<script>var t="<a href=no></p>";</script>', "<SCRIPT async>if (a<b) '<h1>'</SCRIPT >",
    "<style>p{margin:0}/* <img> */</style>", '<div title="<a href=no>">', "<div title='<h1>'>",
    '<meta charset="utf-8">', '<meta name="keywords" content="x">',
    "<p class=it's>", '<img alt=5" src=x>', "<p don't>", '<a href="/x"">', "<a href=/y' z>", '<h1 "quoted" x>',
    "<meta content='name=\"description\"'>", "<articles>", "<header>",
]
METAS = ['<meta name="description" content="x">', "<META content=x name=Description>"]
TITLES = ["<title>One</title>", "<TITLE lang=en>\n Two  words </TITLE>", "<title></title>",
          "<title>A > B</title>"]


def random_pages(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = rng.choices(PIECES, k=rng.randrange(25))
        if rng.random() < 0.3:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(METAS))
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(TITLES))
        out.append("".join(parts))
    return out


@pytest.fixture(scope="module")
def texts():
    return random_pages(1, 600)


def test_audit_equals_html_parser(spark, texts):
    got = {r.page_id: r for r in reports.page_audit(pages_df(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = Audit(text)
        assert (
            got[i].title_length, got[i].n_h1, got[i].n_links, got[i].n_images,
            got[i].has_meta_description,
        ) == (
            len(want.title()), want.counts["h1"], len(want.hrefs), want.counts["img"], want.meta,
        ), text


def test_links_equal_html_parser(spark, texts):
    got = {}
    for r in reports.link_edges(pages_df(spark, texts)).orderBy("page_id", "link_no").collect():
        got.setdefault(r.page_id, []).append((r.link_no, r.href))
    want = {i: list(enumerate(Audit(text).hrefs, 1)) for i, text in enumerate(texts)}
    assert got == {i: links for i, links in want.items() if links}


def test_duplicate_titles(spark, texts):
    want = Counter(Audit(text).title() for text in texts)
    got = {r.title: r.n_pages for r in reports.duplicate_titles(pages_df(spark, texts)).collect()}
    assert got == {t: n for t, n in want.items() if t and n > 1}


HARD = {
    "open comment": ("<a href=1><!-- <a href=2> <h1>", 1, 0),
    "open script": ("<h1><a href=1><script> <a href=2></p>", 1, 1),
    "open tag": ('<h1><a href="1"><a href="2', 1, 1),
    "open quote takes the rest": ('<a href=1><div title="> <a href=2> <h1>', 1, 0),
    "only brackets": ("<" * 1000, 0, 0),
    "comment ends": ("<!--> <a href=1> <!---> <h1> <!-- x --!> <a href=2>", 2, 1),
    "bogus comments": ("<?php <a href=1> ?> <![CDATA[ <h1> ]]> </ <h1> >", 0, 0),
    "quote in an unquoted value": ("<p class=it's><a href=1><h1>", 1, 1),
    "inch mark": ('<img alt=5" src=x><a href=1><h1>', 1, 1),
    "quote in a name": ("<p don't><a href=1><h1>", 1, 1),
    "a quote too many": ('<a href="/x""><a href=1><h1>', 2, 1),
    "equals sign first": ('<p ="x"><a href=1><h1>', 1, 1),
    "two equals signs": ('<p a=="><a href=1><h1>', 1, 1),
    "spaces around equals": ("<p a = '>' b><a href = 1><h1>", 1, 1),
    "text area": ("<textarea><a href=1><h1></textarea><a href=2>", 1, 0),
}


@pytest.mark.parametrize("case", HARD)
def test_malformed_pages(spark, case):
    text, n_links, n_h1 = HARD[case]
    row = reports.page_audit(pages_df(spark, [text])).head()
    assert (row.n_links, row.n_h1) == (n_links, n_h1)


def test_large_malformed_pages_finish(spark):
    """Megabytes of openings that never close: linear time and a flat stack."""
    big = 2_000_000
    texts = [
        "<!--" * big, "<script>" * big, "<a href='" * big, '<a b="' + "x" * big, "<a " + "x=1 " * big,
        "<a " + "'' " * big + "href=z>", "<title>" * big, "<a href=1>" * (big // 10), None,
    ]
    got = [r.n_links for r in reports.page_audit(pages_df(spark, texts)).orderBy("page_id").collect()]
    assert got[5] == 1 and got[7] == big // 10 and sum(n or 0 for n in got) == 1 + big // 10


def test_whole_text_is_read(spark):
    text = "<p>" + "word " * 400_000 + "<a href=/end><h1>"
    row = reports.page_audit(pages_df(spark, [text])).head()
    assert (row.n_links, row.n_h1) == (1, 1)


def test_page_without_text(spark):
    df = pages_df(spark, [None, ""])
    got = [tuple(r) for r in reports.page_audit(df).orderBy("page_id").collect()]
    assert got == [(0, "a.example", *[None] * 5), (1, "a.example", 0, 0, 0, 0, False)]
    assert reports.link_edges(df).isEmpty() and reports.duplicate_titles(df).isEmpty()


URLS = {
    "https://Www.Example.com/a/?q=1#f": ("www.example.com", "example.com/a"),
    "http://m.example.com": ("m.example.com", "example.com"),
    "http://m.example.com//": ("m.example.com", "example.com"),
    "http://www.m.example.com/": ("www.m.example.com", "m.example.com"),
    "http://m.com/a": ("m.com", "m.com/a"),
    "http://www.com": ("www.com", "www.com"),
    "http://user:pw@example.com:8080/A": ("example.com", "user:pw@example.com:8080/A"),
    "http://[::1]:80/x": ("[::1]", "[::1]:80/x"),
    "http://bad_host.example/x y|z": ("bad_host.example", "bad_host.example/x y|z"),
    "http://example.com?x=/y/": ("example.com", "example.com"),
    "/relative/path": (None, None),
    "mailto:someone@example.com": (None, None),
    "": (None, None),
    None: (None, None),
}


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = {r[0]: (r[1], r[2]) for r in df.select(
        "url", urls.host("url"), urls.canonical("url")).collect()}
    assert got == URLS


def test_canonical_groups(spark):
    names = ["http://www.a.example/x", "https://a.example/x/", "https://m.a.example/x?y#z",
             "http://a.example/X", "/x", "/x", None, None]
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(names)], PAGES_SCHEMA)
    assert [tuple(r) for r in reports.canonical_groups(df).collect()] == [("a.example/x", 3)]


def test_top_pages_ties_and_one_big_host(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        host = "big.example" if i % 3 == 0 else f"h{rng.randrange(200)}.example"
        rows.append((i, f"http://{host}/{i}", "<a href=x>" * rng.randrange(4)))
    rows.append((900, None, "<a href=x>"))
    want = {}
    for page_id, url, text in rows[:-1]:
        want.setdefault(url.split("/")[2], []).append((-text.count("<a"), page_id))
    expected = {(h, rank, p, -n) for h, ps in want.items()
                for rank, (n, p) in enumerate(sorted(ps)[:3], 1)}
    df = spark.createDataFrame(rows, PAGES_SCHEMA).repartition(5)
    got = reports.top_pages(df).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_attribute_is_null_when_missing(spark):
    df = spark.createDataFrame([("a x=1>",), ("a href=''>",), ('a href="v">',)], "t string")
    assert [r[0] for r in df.select(html.attribute(F.col("t"), "a", "href")).collect()] == [None, "", "v"]
