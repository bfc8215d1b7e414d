"""Markup that the given pages lack."""

import pytest
from pyspark.sql import functions as F

from pagelens.functions import html

PAGE = """<!DOCTYPE html><html><head><title> A <b>bold</b> &amp; new&nbsp;page </title>
<meta content='It&#39;s &quot;about&quot;' name="description"><style>p{}</style>
<script>var t = "</p><a href='/no'>x</a>";</script></head><body><!-- <a href="/hidden">h</a> -->
<h2>Second</h2><h1>First <i>one</i></h1><h6>Last</h6><p>One<p>Two  three &#x20AC;5 &#233;t&eacute;
<a class="x" href="https://other.org/a?b=1&amp;c=2">Out <b>side</b></a><a href='/root/page'>Root</a>
<a href="//cdn.org/x">Proto</a><a href="#frag">F</a><a href="mailto:a@b.c">M</a><a href="rel/page">R</a><a name="n">N</a>
<img src="/i.png" alt="An > image"><img title='T' src=https://img.org/j.png><img src="data:x"></body></html>"""


@pytest.fixture(scope="module")
def record(spark):
    rows = [(1, "https://site.org:8080/dir/p?q=1", PAGE), (2, "http://b.org/", ""), (3, "http://c.org/", "<p>no title</p>"),
            (4, "http://d.org", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r["page_id"]: r.asDict(recursive=True) for r in html.parse_pages(df).collect()}


def test_title_and_description(record):
    assert record[1]["title"] == "A bold & new\u00a0page"
    assert record[1]["description"] == "It's \"about\""
    assert record[3]["title"] == "No title" and record[3]["description"] == ""


def test_text(record):
    text = record[1]["text_content"]
    assert "var t" not in text and "p{}" not in text and "hidden" not in text
    assert "One Two three €5 été" in text
    assert "First one" in text and record[1]["word_count"] == len(text.split())
    assert "SecondFirst one" in record[1]["text_fused"]


def test_links(record):
    assert [(x["url"], x["text"]) for x in record[1]["links"]] == [
        ("https://other.org/a?b=1&c=2", "Out side"),
        ("https://site.org:8080/root/page", "Root"),
        ("https://cdn.org/x", "Proto"),
    ]


def test_images(record):
    assert [(x["url"], x["alt"], x["title"]) for x in record[1]["images"]] == [
        ("https://site.org:8080/i.png", "An > image", ""),
        ("https://img.org/j.png", "", "T"),
    ]


def test_headers(record):
    assert [(x["level"], x["text"]) for x in record[1]["headers"]] == [(1, "First one"), (2, "Second"), (6, "Last")]


def test_blank_pages_are_error_rows(record):
    assert record[2]["error"] == record[4]["error"] == "empty page"
    assert record[1]["error"] is None and record[2]["word_count"] == 0 and record[2]["links"] == []


@pytest.mark.parametrize(
    "url,page,kind",
    [
        ("https://x.org/SPA/", "", "javascript"),
        ("https://x.org/", "<div DATA-REACTROOT>", "javascript"),
        ("https://x.org/", "<p>plain</p>", "static"),
        ("https://x.org/", None, "dynamic"),
    ],
)
def test_rendering(spark, url, page, kind):
    df = spark.createDataFrame([(url, page)], "u string, h string")
    assert df.select(html.detect_rendering(F.col("u"), F.col("h"))).first()[0] == kind


def test_long_tag_does_not_overflow(spark):
    page = "<p data='" + "x" * 200_000 + "' " + "a=1 " * 50_000 + ">text</p>"
    df = spark.createDataFrame([(1, "http://a.org/", page)], "page_id bigint, url string, html string")
    assert html.parse_pages(df, ("text_content",)).first()["text_content"] == "text"


def test_all_named_references_and_unclosed_blocks(one):
    from pagelens.functions.html import decode_entities, visible_text

    assert one(lambda c: decode_entities(F.col("x")), "caf&eacute; M&uuml;nchen &rsquo;&laquo; &amp;lt; &unknown; &AMP") == "café München ’« &lt; &unknown; &"
    shown = one(lambda c: visible_text(html.without_code(F.col("x"))), "<p>a</p><script>var x=1;")
    assert shown.strip() == "a"


REFERENCES = [
    "", "plain", "&", "&&", "& &", "a & b", "AT&T", "&;", "&#;", "&#x;", "&lt;b&gt;", "&#38;lt;b&#38;gt;", "&AMP;lt; &LT", "&amp;amp;lt;",
    "&copy 2020 &eacute", "&copy2020", "&notit; &notin; &not", "&ampamp;", "&nbspx", "&frac12;&frac1", "&unknown; &unknown", "&#65&#66;C",
    "&#x41;&#X42&#x43", "&#0;&#00000000000065;&#x80;&#150;&#x9f;&#129;", "&#1;&#11;&#12;&#13;&#127;&#xfdd0;&#x1ffff;", "&#xD800;&#x110000;&#99999999999;",
    "&#x10FFFF;&#x10FFFD;&#128512;", "&NotEqualTilde;&ngE;&fjlig;", "&CounterClockwiseContourIntegral;", "x&eacute;&Eacute;&ecute;", "&lt&lt;&ltlt",
    "&a b;", "&\t&\n", "\u00e9&eacute;\u4e2d&#20013;", "&quot;&apos;&QUOT", "&" + "a" * 40 + ";", "&amp", "&gt;&GT;&gT;", "&#38;amp;lt;", "a&lt", "&#9;|&#10;|&#32;",
]


def test_references_equal_those_of_html(spark):
    from html import unescape

    df = spark.createDataFrame([(t,) for t in REFERENCES], "t string")
    for r in df.select("t", html.decode_entities(F.col("t")).alias("out")).collect():
        assert r["out"] == unescape(r["t"]), r["t"]


def test_decoded_markup_stays_text(spark):
    page = "<title>&#38;lt;b&#38;gt; &copy 2020</title><h1>1 &lt 2 &amp;amp; 3</h1><a href='/x?a=1&amp;b=2'>&lt;i&gt;</a><p>&AMP;lt; &amp;copy;</p>"
    row = html.parse_pages(spark.createDataFrame([(1, "https://s.org/", page)], "page_id bigint, url string, html string")).first()
    assert row["title"] == "&lt;b&gt; \u00a9 2020"
    assert [h["text"] for h in row["headers"]] == ["1 < 2 &amp; 3"]
    assert [(x["url"], x["text"]) for x in row["links"]] == [("https://s.org/x?a=1&b=2", "<i>")]
    assert "&lt; &copy;" in row["text_content"]
