"""Static HTML expressions: what a reader of the page would see.

Scripts and style sheets are not run, so content they add or hide is out of
reach. Patterns avoid look-around so that any regex engine can share them.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlens.functions.text import literal_map
from harvestlens.functions.urls import absolute_href, tidy_path

SPACE = r"[ \t\r\n\f]"
_ATTRS = rf"(?:{SPACE}[^>]*)?>"

COMMENT = r"(?s)<!--.*?(?:-->|\z)"
# Alternatives share their first character, so that the scan for it stays a single comparison.
UNRENDERED = r"(?is)<(?:!--.*?(?:-->|\z)|" + "|".join(
    rf"{tag}{_ATTRS}.*?(?:</{tag}[^>]*>|\z)" for tag in ("script", "style", "noscript", "template")
) + ")"
TITLE = rf"(?is)<title{_ATTRS}(.*?)(?:</title|\z)"
BODY = rf"(?is)<body{_ATTRS}(.*)"
TITLE_PART = rf"(?is)<title{_ATTRS}.*?(?:</title[^>]*>|\z)"
# For pages without a body tag.
HEAD = rf"(?is)<(?:head{_ATTRS}.*?</head[^>]*>|title{_ATTRS}.*?(?:</title[^>]*>|\z))"
# A line break set by a tag, kept apart from those of the source.
BREAK = "\x1e"
LINE_TAG = (
    r"(?i)<(?:br|/?(?:p|div|li|ul|ol|dl|dt|dd|tr|table|h[1-6]|section|article|header|footer|nav|main|aside"
    r"|blockquote|pre|form|fieldset|figure|figcaption|address|hr|option|body|html))(?:[ /][^>]*)?>"
)
CELL_TAG = r"(?i)</?(?:td|th)(?:[ /][^>]*)?>"
TAG = r"<[/!?A-Za-z][^>]*(?:>|\z)"
SPACE_RUN = r"[\t\r\n\f][ \t\r\n\f]*| [ \t\r\n\f]+"
AROUND_BREAK = r" ?\x1E[ \x1E]*"
EDGES = " \t\r\n\f"
ANCHOR = rf"(?i)<a{SPACE}"
# A pattern engine goes one call deeper per attribute, so tags are read up to this many: a target behind
# more attributes is not seen, and quotes in such a tag have no meaning.
MOST_ATTRIBUTES = "{0,500}"
# One attribute and the white space after it. Possessive, as an attribute has one reading only.
ATTRIBUTE = (
    rf"(?:[^ \t\r\n\f=>]++(?:{SPACE}*+={SPACE}*+"
    rf"""(?:"[^"]*+"|'[^']*+'|[^ \t\r\n\f"'>][^ \t\r\n\f>]*+)?+)?+{SPACE}*+|={SPACE}*+)"""
)
ANCHOR_WITH_HREF = rf"(?i)<a{SPACE}++{ATTRIBUTE}{MOST_ATTRIBUTES}?href{SPACE}*="
ANCHOR_ATTRS = r"^([^>]*)>"
ANCHOR_BODY = r"(?is)^[^>]*>(.*?)(?:</a[^A-Za-z0-9]|\z)"
HREF = rf"""(?i)^{SPACE}*+{ATTRIBUTE}{MOST_ATTRIBUTES}?href{SPACE}*(={SPACE}*(?:"[^"]*"|'[^']*'|[^ \t\r\n\f"'>]*))"""
BASE_ATTRS = rf"(?i)<base{SPACE}([^>]*)>"
HREF_WRAP = r"""^=[ \t\r\n\f]*["']?[ \t\r\n\f]*|[ \t\r\n\f]*["']?\z"""
FRAME = r"(?i)<i?frame[ \t\r\n\f/>]"

# A tag with quoted attribute values, and what shows that some quoted value may hold a bracket.
QUOTED_TAG = (
    rf"</?[A-Za-z][^>=]*+(?:=(?:{SPACE}*+"
    rf"""(?:"[^"]*+"|'[^']*+'))?+[^>=]*+){MOST_ATTRIBUTES}+>"""
)
BRACKET_IN_QUOTES = rf"""={SPACE}*(?:"[^"<>]*[<>]|'[^'<>]*[<>])"""

# A character reference behind its ampersand, as the HTML standard reads it.
REFERENCE = r"^(#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[^\t\n\f <&#;]{1,32};?)"
# Names that count without a semicolon too, whatever follows them; the longest has six letters.
BARE_NAMES = {name: char for name, char in html5.items() if not name.endswith(";")}
LONGEST_BARE = max(map(len, BARE_NAMES))
# What the standard makes of the numbers 128 to 159, in order.
C1_CHARACTERS = (
    "\u20ac\x81\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\x8d\u017d\x8f"
    "\x90\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\x9d\u017e\u0178"
)


def _number(code: Column) -> Column:
    """Character of a code; codes that name none give U+FFFD, those of no text nothing."""
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    controls = code.between(1, 8) | code.between(14, 31) | code.between(127, 159) | (code == 11)
    no_text = controls | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (
        F.when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd")
        .when(code == 13, "\r")
        .when(code.between(128, 159), F.substr(F.lit(C1_CHARACTERS), code - 127, F.lit(1)))
        .when(no_text, "")
        .otherwise(char)
    )


def _code(digits: Column, hexadecimal: Column) -> Column:
    # More digits than any character has are too large, whatever they are.
    return (
        F.when(F.length(digits) > 7, F.lit(0x110000))
        .when(digits == "", 0)
        .when(hexadecimal, F.conv(digits, 16, 10).try_cast("int"))
        .otherwise(digits.try_cast("int"))
    )


def _named(mark: Column) -> Column:
    """The named reference, with what follows a name that counts without a semicolon; NULL for an unknown one."""
    known, bare = F.element_at(literal_map(html5), mark), literal_map(BARE_NAMES)
    heads = [F.concat(F.element_at(bare, F.left(mark, F.lit(n))), F.substr(mark, F.lit(n + 1))) for n in range(LONGEST_BARE, 1, -1)]
    return F.coalesce(known, *heads)


def decode_entities(text: Column) -> Column:
    """Replace character references by their characters, each once: named ones of the standard, and all numbers.

    No reference holds an ampersand, so each piece between two of them is decoded on its
    own. Each step is an array pass, so that its result is computed once.
    """
    pieces = F.split(text, "&")
    rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    marked = F.transform(rest, lambda p: F.struct(p.alias("piece"), F.regexp_extract(p, REFERENCE, 1).alias("mark")))
    numbered = F.transform(
        marked,
        lambda x: F.struct(
            x["piece"].alias("piece"), x["mark"].alias("mark"),
            F.when(x["mark"].startswith("#"), F.regexp_replace(x["mark"], "^#[xX]?0*|;", "")).alias("digits"),
        ),
    )
    coded = F.transform(
        numbered,
        lambda x: F.struct(
            x["piece"].alias("piece"), x["mark"].alias("mark"),
            F.when(x["digits"].isNotNull(), _code(x["digits"], F.lower(x["mark"]).startswith("#x"))).alias("code"),
        ),
    )
    decoded = F.transform(
        coded,
        lambda x: F.coalesce(
            F.concat(
                F.when(x["code"].isNotNull(), _number(x["code"])).when(x["mark"] != "", _named(x["mark"])),
                F.substr(x["piece"], F.length(x["mark"]) + 1),
            ),
            F.concat(F.lit("&"), x["piece"]),
        ),
    )
    return F.when(F.contains(text, F.lit("&")), F.concat(F.get(pieces, F.lit(0)), F.array_join(decoded, ""))).otherwise(text)


def guarded(markup: Column) -> Column:
    """Markup whose quoted attribute values hold no angle brackets: they become references, as they may be written."""
    tags = F.array_distinct(F.regexp_extract_all(markup, F.lit(QUOTED_TAG), F.lit(0)))
    inside = lambda tag: F.substr(tag, F.lit(2), F.length(tag) - 2)
    open_ = F.filter(tags, lambda tag: inside(tag).rlike("[<>]"))
    replaced = F.aggregate(
        open_,
        markup,
        lambda acc, tag: F.replace(
            acc, tag, F.concat(F.lit("<"), F.replace(F.replace(inside(tag), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit(">"))
        ),
    )
    return F.when(markup.rlike(BRACKET_IN_QUOTES), replaced).otherwise(markup)


def rendered_markup(html: Column) -> Column:
    """Markup without comments, scripts, styles, noscript and template parts; attribute values are guarded."""
    return guarded(F.regexp_replace(html, UNRENDERED, ""))


def title_text(markup: Column) -> Column:
    """Raw title of rendered markup, white space collapsed, references not yet decoded."""
    return F.btrim(F.regexp_replace(F.regexp_extract(markup, TITLE, 1), SPACE_RUN, " "), F.lit(EDGES))


def with_marked_text(df: DataFrame, markup: str, out: str) -> DataFrame:
    """Add the body of rendered markup with breaks marked and tags gone, references not yet decoded.

    One column per step, so that a step read by a condition is not computed again.
    """
    return (
        df.withColumn("_after_body", F.regexp_extract(markup, BODY, 1))
        .withColumn(
            "_body",
            F.when(F.col("_after_body") == "", F.regexp_replace(markup, HEAD, ""))
            .when(F.contains("_after_body", F.lit("<title")), F.regexp_replace("_after_body", TITLE_PART, ""))
            .otherwise(F.col("_after_body")),
        )
        .withColumn("_lines", F.regexp_replace("_body", LINE_TAG, BREAK))
        .withColumn(
            "_lines",
            F.when(
                F.contains("_lines", F.lit("<t")) | F.contains("_lines", F.lit("<T")),
                F.regexp_replace("_lines", CELL_TAG, " "),
            ).otherwise(F.col("_lines")),
        )
        .withColumn(out, F.regexp_replace("_lines", TAG, ""))
        .drop("_after_body", "_body", "_lines")
    )


def tidy_lines(text: Column) -> Column:
    """Collapse white space, turn marked breaks into line ends and trim."""
    tidy = F.regexp_replace(F.regexp_replace(text, SPACE_RUN, " "), AROUND_BREAK, "\n")
    return F.btrim(tidy, F.lit(EDGES))


def full_text(html: Column) -> Column:
    """All body text including script content, references not yet decoded."""
    shown = F.regexp_replace(html, COMMENT, "")
    body = F.regexp_extract(shown, BODY, 1)
    return F.regexp_replace(F.when(body != "", body).otherwise(F.regexp_replace(shown, HEAD, "")), TAG, "")


def count_links(markup: Column) -> Column:
    """Anchors that carry a target."""
    return F.regexp_count(markup, F.lit(ANCHOR_WITH_HREF))


def count_frames(markup: Column) -> Column:
    """Frames of the page, the main frame included."""
    return F.regexp_count(markup, F.lit(FRAME)) + 1


def anchor_chunks(markup: Column) -> Column:
    """Markup cut at each anchor start; an anchor ends at the latest where the next begins."""
    chunks = F.split(markup, ANCHOR)
    return F.slice(chunks, 2, F.greatest(F.size(chunks) - 1, F.lit(0)))


def base_target(markup: Column) -> Column:
    """Target of the first base element, '' without one."""
    target = F.regexp_extract(F.regexp_extract(markup, BASE_ATTRS, 1), HREF, 1)
    return decode_entities(F.regexp_replace(target, HREF_WRAP, ""))


def links_of(chunks: Column, bases: Column) -> Column:
    """ARRAY<STRUCT<text, href>> of the anchors with a target.

    ``bases`` is :func:`harvestlens.functions.urls.base_of` of the page. Each
    step is an array pass of its own, so that its result is computed once and
    not once per mention.
    """
    raw = F.transform(
        chunks,
        lambda c: F.struct(
            F.regexp_extract(F.regexp_extract(c, ANCHOR_ATTRS, 1), HREF, 1).alias("href"),
            F.regexp_extract(c, ANCHOR_BODY, 1).alias("label"),
        ),
    )
    targeted = F.filter(raw, lambda r: r["href"] != "")
    plain = F.transform(
        targeted,
        lambda r: F.struct(
            F.regexp_replace(r["href"], HREF_WRAP, "").alias("href"),
            F.regexp_replace(F.regexp_replace(r["label"], LINE_TAG, BREAK), TAG, "").alias("label"),
        ),
    )
    decoded = F.transform(
        plain,
        lambda r: F.struct(
            decode_entities(r["href"]).alias("href"), tidy_lines(decode_entities(r["label"])).alias("text")
        ),
    )
    absolute = F.transform(
        decoded, lambda r: F.struct(r["text"].alias("text"), absolute_href(bases, r["href"]).alias("href"))
    )
    links = F.transform(absolute, lambda r: F.struct(r["text"].alias("text"), tidy_path(r["href"]).alias("href")))
    return F.filter(links, lambda link: link["href"] != "")
