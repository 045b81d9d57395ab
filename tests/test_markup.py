"""Markup, references and targets whose reading is known: quotes, named and numeric references, RFC 3986."""

import html as stdlib
import random
from html.entities import html5
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from harvestlens.functions import html as H
from harvestlens.functions.urls import base_of, resolve_href
from harvestlens.operators import pages


def inspected(spark, html, url="https://e.org/d/page?q=1#f"):
    return pages.inspect_pages(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")).first()


def test_brackets_in_quotes_stay_in_their_tag(spark):
    r = inspected(spark, """<html><body><p title="a > b" data='<a href="/no">'>one</p>
     <a title="x > y" class='>>' href="/lost">two <img alt="</a>"> more</a><a title="see href='/wrong'" HREF = /right>three</a>
     <a name="here">no link</a><a data-href="/no">none</a> 1 < 2 and 3 > 2</body></html>""")
    assert [(x.text, x.href) for x in r.links] == [("two more", "https://e.org/lost"), ("three", "https://e.org/right")]
    assert r.link_count == 2
    assert " ".join(r.text.split()) == "one two morethree no linknone 1 < 2 and 3 > 2"


@pytest.mark.parametrize("attributes, href", [
    ("href=x", "x"), ('class=a href="x y"', "x y"), ("class='a'href='x'", "x"), ("= href=x", "x"), ("a=1 b = '2' c HREF=x>", "x"),
    ("data-href=x", None), ("hrefs=x", None), ("title='href=x'", None), ("title=\"a' href='b\" href=c", "c"), ("href=\"a>b\"", "a>b"),
])
def test_target_of_an_anchor(spark, attributes, href):
    r = inspected(spark, f"<body><a {attributes}>t</a> text</body>", "https://e.org/")
    assert [x.href for x in r.links] == ([f"https://e.org/{href}"] if href else [])
    assert r.link_count == len(r.links)


def test_long_and_cut_tags_end(spark):
    r = inspected(spark, "<body>text <a " + "a='1' " * 400 + "href=/x>t</a><a " + 'b="2" ' * 20_000)
    assert r.links[0].href == "https://e.org/x" and r.text.startswith("text")
    assert inspected(spark, '<p x=">"><a ' + "a='1' " * 20_000 + "href=/x>t</a>").text == "t"


def test_references_decode_as_the_standard_library_does(spark):
    rng = random.Random(2)
    names = sorted(html5)
    texts = [f"a&{n}b &{n} &{n};" for n in names]
    numbers = [0, 1, 9, 10, 11, 12, 13, 31, 38, 60, 127, 128, 130, 159, 160, 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**12, 233]
    texts += [f"x&#{n};y&#{n} &#x{n:x};&#X{n:X}z&#000000000{n};" for n in numbers]
    texts += ["&", "&&amp;", "&amp;lt;", "&#38;lt;", "&ampamp;", "&notit; &notin; &not", "&#;", "&#x;", "& amp;", "a&b=c&copy=1", "", "no", "&unknown;"]
    texts += ["".join(rng.choices(["&", "amp", "lt", ";", "#", "x", "41", "not", "in", " ", "<"], k=9)) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8).select("t", H.decode_entities(F.col("t")).alias("d")).collect()
    assert len(rows) == len(texts)
    wrong = [(r.t, r.d, stdlib.unescape(r.t)) for r in rows if r.d != stdlib.unescape(r.t)]
    assert wrong == []


# Examples of RFC 3986, sections 5.4.1 and 5.4.2, against its base.
BASE = "http://a/b/c/d;p?q"
RFC = {
    "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y",
    "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x",
    "g;x": "http://a/b/c/g;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/",
    "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g",
    "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g",
    "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h",
    "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x",
    "g?y/../x": "http://a/b/c/g?y/../x", "g#s/../x": "http://a/b/c/g#s/../x", "mailto:x@e.org": "mailto:x@e.org",
}


def test_targets_of_the_rfc(spark):
    rows = spark.createDataFrame([(BASE, h) for h in RFC], "url string, href string")
    got = {r.href: r.full for r in rows.select("href", resolve_href(base_of(F.col("url")), F.col("href")).alias("full")).collect()}
    assert got == RFC


def test_targets_like_the_standard_library(spark):
    rng = random.Random(4)
    parts = ["a", "b.html", "..", ".", "", "x y", "é"]
    hrefs = ["/".join(rng.choices(parts, k=rng.randrange(1, 6))) + rng.choice(["", "?q=../x", "#f/./g"]) for _ in range(300)]
    hrefs = [h for h in hrefs if not h.startswith("//") and "//" not in h]
    base = "https://e.org/one/two/three"
    rows = spark.createDataFrame([(base, h) for h in hrefs], "url string, href string")
    for r in rows.select("href", resolve_href(base_of(F.col("url")), F.col("href")).alias("full")).collect():
        assert r.full == urljoin(base, r.href), r.href


@pytest.mark.parametrize("base, href", [
    ('<base href="/other/">', "https://e.org/other/x"), ("<base target=_blank><base href='sub/'>", "https://e.org/d/x"),
    ('<base href="http://f.net/a/b">', "http://f.net/a/x"), ('<base href="../">', "https://e.org/x"), ("", "https://e.org/d/x"),
])
def test_the_first_base_counts(spark, base, href):
    r = inspected(spark, f"<html><head>{base}<base href='http://no.example/'></head><body><a href=x>t</a></body></html>" if base else "<a href=x>t</a>")
    assert r.links[0].href == href
