import pytest
from pyspark.sql import functions as F

from harvestlens.functions import html as H
from harvestlens.functions.urls import base_of, normalize_url, resolve_href, url_problem
from harvestlens.operators import fetch, pages


def value(spark, column_of, text):
    return spark.createDataFrame([(text,)], "x string").select(column_of(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("https://example.com/", "https://example.com/"),
        ("http://example.com/", "http://example.com/"),
        ("  https://example.com/  ", "https://example.com/"),
        ('"https://example.com/"', "https://example.com/"),
        ("' <https://example.com/> '", "https://example.com/"),
        ("[https://example.com/](https://example.com/)", "https://example.com/"),
        ("[a b](HTTPS://example.com/x)", "HTTPS://example.com/x"),
        ("<ftp://example.com/>", "<ftp://example.com/>"),
        ('"', '"'),
        ("", ""),
    ],
)
def test_normalize_url(spark, raw, clean):
    assert value(spark, normalize_url, raw) == clean


@pytest.mark.parametrize(
    "url, usable",
    [
        ("https://example.com/", True),
        ("HTTP://example.com", True),
        ("http://a_b.com/x y", True),
        ("ftp://example.com/file", False),
        ("https:///p", False),
        ("http://[::1/x", False),
        ("example.com", False),
        ("http:example.com", False),
        (None, False),
    ],
)
def test_url_problem(spark, url, usable):
    assert (value(spark, url_problem, url) is None) is usable


def test_validate_urls_reports_type(spark):
    row = fetch.validate_urls(spark.createDataFrame([("ftp://example.com/file",)], "raw_url string")).first()
    assert (row.valid, row.error_type, row.recoverable) == (False, "InvalidURL", False)
    assert row.message == "Unsupported URL scheme: 'ftp'"


@pytest.mark.parametrize(
    "href, target",
    [
        ("/word", "https://h.org/word"),
        ("//cdn.org/x", "https://cdn.org/x"),
        ("?q=1", "https://h.org/a/b?q=1"),
        ("#top", "https://h.org/a/b?x=2#top"),
        ("", "https://h.org/a/b?x=2"),
        ("c.html", "https://h.org/a/c.html"),
        ("mailto:me@h.org", "mailto:me@h.org"),
        ("HTTP://other.org/", "HTTP://other.org/"),
    ],
)
def test_resolve_href(spark, href, target):
    assert value(spark, lambda x: resolve_href(base_of(F.lit("https://h.org/a/b?x=2#f")), x), href) == target


def test_resolve_href_of_a_bare_host(spark):
    assert value(spark, lambda x: resolve_href(base_of(F.lit("https://h.org")), x), "c") == "https://h.org/c"


@pytest.mark.parametrize(
    "text, decoded",
    [
        ("a &lt; b &amp;&amp; c", "a < b && c"),
        ("&amp;lt;", "&lt;"),
        ("&#233;&#xE9;&#x1F600;", "éé\U0001f600"),
        ("&#38;amp;", "&amp;"),
        ("&nosuch; &#0; &#xD800; &#99999999;", "&nosuch; \ufffd \ufffd \ufffd"),
        ("AT&T", "AT&T"),
        ("&nbsp;x", " x"),
    ],
)
def test_decode_entities(spark, text, decoded):
    assert value(spark, H.decode_entities, text) == decoded


def inspect(spark, html, url="https://h.org/a/"):
    return pages.inspect_pages(spark.createDataFrame([(1, url, html)], "id int, url string, html string")).first()


def test_plain_page(spark):
    page = inspect(
        spark,
        "<html><head><title> Example\n Domain </title></head><body><h1>Example Domain</h1>"
        "<p>One &amp;\n two<br>three</p><script>var t='</p><a href=\"/no\">';</script>"
        '<table><tr><td>a</td><td>b</td></tr></table><a href="/more?a=1&amp;b=2"><b>More</b> info</a></body></html>',
    )
    assert page.success and not page.blocked and page.empty_page is False and page.block_type is None
    assert page.title == "Example Domain"
    assert page.text == "Example Domain\nOne & two\nthree\na b\nMore info"
    assert [tuple(x) for x in page.links] == [("More info", "https://h.org/more?a=1&b=2")]
    assert (page.link_count, page.iframe_count, page.message, page.recoverable) == (1, 1, None, True)


def test_anchor_forms(spark):
    page = inspect(
        spark,
        "<body><a name=x>none</a><a href=''>self</a><a class=y HREF = one>1</a><A HREF='two'>2"
        '<a data-href="no">skip</a><!-- <a href="/gone">x</a> --><abbr href="no">z</abbr><a href="#f"></a></body>',
    )
    assert [tuple(x) for x in page.links] == [
        ("self", "https://h.org/a/"), ("1", "https://h.org/a/one"), ("2", "https://h.org/a/two"),
        ("", "https://h.org/a/#f"),
    ]
    assert page.link_count == 4


@pytest.mark.parametrize(
    "html",
    [
        "<script>window.failureConfig = 1; '/TSPD/x'</script>",
        "<title>Security Check</title><body>CAPTCHA verification required</body>",
        "<body>protected by CloudFlare</body>",
        "<body>access <b>denied</b></body>",
    ],
)
def test_blocked_pages(spark, html):
    page = inspect(spark, html)
    assert (page.success, page.blocked, page.block_type) == (False, True, "anti_bot_challenge")
    assert page.empty_page is None and page.message == pages.BLOCKED_MESSAGE


def test_empty_page(spark):
    page = inspect(spark, "<html><head><title>T</title></head><body> \n&nbsp; </body></html>")
    assert (page.success, page.blocked, page.empty_page, page.text, page.link_count) == (False, False, True, "", 0)
    assert page.message == pages.EMPTY_MESSAGE and page.links == []


def test_script_text_stands_in_for_missing_text(spark):
    page = inspect(spark, "<body><script>render()</script></body>")
    assert page.success and page.text == "render()"


def test_titles_inside_the_body_are_no_text(spark):
    page = inspect(spark, "<title>T</title><body>a<svg><title>icon</title></svg>b\n <td>c</td></body>")
    assert (page.title, page.text) == ("T", "ab c")


def test_page_without_body_tag(spark):
    page = inspect(spark, "<head><title>T</title><meta x></head><p>one</p>two")
    assert page.text == "one\ntwo"


def test_missing_markup(spark):
    page = inspect(spark, None)
    assert page.empty_page and page.html_length == 0


def test_limits_and_counts(spark):
    html = "<body>" + "<a href='/x'>y</a> " * 250 + "<p>" + "z" * 60_000 + "<iframe src=a></iframe><frame src=b>"
    page = inspect(spark, html)
    assert (page.link_count, len(page.links), page.iframe_count) == (250, 200, 3)
    assert len(page.text) == 20_000 and page.html_length == len(html) and len(page.html_preview) == 50_000


def test_link_count_agrees_with_link_list(spark):
    got = pages.page_link_counts(pages.page_links(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")))
    assert got.filter("link_count <> size(links)").count() == 0
    assert got.agg(F.sum("link_count")).first()[0] == 1413


@pytest.mark.parametrize(
    "source, name, error",
    [
        ("s", "f.csv", None), (" ", "f", "InvalidSourceId"), ("../x", "f", "InvalidSourceId"),
        ("..", "f", "InvalidSourceId"), ("s", "", "InvalidFilename"), ("s", "a/b", "InvalidFilename"),
        ("s", "a\\b", "InvalidFilename"), ("s", "..", "InvalidFilename"), (None, None, "InvalidSourceId"),
    ],
)
def test_fetch_requests(spark, source, name, error):
    row = fetch.check_fetch_requests(
        spark.createDataFrame([(source, name)], "source_id string, filename string")
    ).first()
    assert row.error_type == error and row.recoverable == (None if error is None else False)


@pytest.mark.parametrize(
    "status, exc, expected",
    [
        (200, None, (True, None, None)),
        (404, None, (False, "HTTPError", False)),
        (500, None, (False, "HTTPError", True)),
        (None, "Timeout", (False, "Timeout", True)),
        (None, "ConnectionError", (False, "RequestException", True)),
        (None, "HTTPError", (False, "HTTPError", False)),
    ],
)
def test_fetch_outcomes(spark, status, exc, expected):
    row = fetch.classify_fetch_outcomes(
        spark.createDataFrame([(status, exc)], "status_code int, exception_class string")
    ).first()
    assert (row.success, row.error_type, row.recoverable) == expected
