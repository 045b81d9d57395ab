"""URL expressions. Patterns avoid look-around so that any regex engine can share them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harvestlens.functions.text import BLANK, trim_blank

QUOTED = r"""(?s)^(?:"(.*)"|'(.*)')\z"""
MARKDOWN_LINK = r"(?i)^\[[^\]]+\]\((https?://[^)]+)\)\z"
ANGLED = rf"(?is)^<({BLANK}*https?://.*)>\z"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
NO_FRAGMENT = r"^([^#]*)"
NO_QUERY = r"^([^?#]*)"
DIRECTORY = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)"

WITH_PATH = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)(/[^?#]*)(.*)\z"


def normalize_url(raw: Column) -> Column:
    """Peel white space, one pair of quotes, a markdown link and angle brackets, in that order."""
    url = trim_blank(raw)
    url = trim_blank(F.regexp_replace(url, QUOTED, "$1$2"))
    url = trim_blank(F.regexp_replace(url, MARKDOWN_LINK, "$1"))
    return trim_blank(F.regexp_replace(url, ANGLED, "$1"))


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, HOST, 1)


def url_problem(url: Column) -> Column:
    """Message for an unusable URL, NULL for a usable one."""
    host = host_of(url)
    return (
        F.when(url.isNull(), F.lit("Browser URL must be a string."))
        .when(
            ~scheme_of(url).isin("http", "https"),
            F.concat(F.lit("Unsupported URL scheme: '"), scheme_of(url), F.lit("'")),
        )
        .when(
            (host == "") | (host.contains("[") != host.contains("]")),
            F.concat(F.lit("Invalid browser URL: "), url),
        )
    )


def base_of(page_url: Column) -> Column:
    """STRUCT of what relative targets on a page are resolved against."""
    directory = F.regexp_extract(page_url, DIRECTORY, 1)
    return F.struct(
        F.regexp_extract(page_url, SCHEME, 1).alias("scheme"),
        F.regexp_extract(page_url, ORIGIN, 1).alias("origin"),
        F.regexp_extract(page_url, NO_FRAGMENT, 1).alias("page"),
        F.regexp_extract(page_url, NO_QUERY, 1).alias("path"),
        F.regexp_replace(directory, r"([^/])$", "$1/").alias("directory"),
    )


def _without_dot_segments(path: Column) -> Column:
    """A path whose ``.`` and ``..`` segments took effect; it stays absolute."""
    segments = F.split(path, "/")
    stack = F.aggregate(
        F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .when(part == ".", kept)
        .otherwise(F.array_append(kept, part)),
    )
    ends_above = F.element_at(segments, -1).isin(".", "..")
    return F.concat(F.lit("/"), F.array_join(stack, "/"), F.when(ends_above & (F.size(stack) > 0), "/").otherwise(""))


def tidy_path(url: Column) -> Column:
    """An absolute URL without dot segments in its path; others as they are."""
    path = F.regexp_extract(url, WITH_PATH, 2)
    tidy = F.concat(F.regexp_extract(url, WITH_PATH, 1), _without_dot_segments(path), F.regexp_extract(url, WITH_PATH, 3))
    return F.when(path.contains("/."), tidy).otherwise(url)


def absolute_href(base: Column, href: Column) -> Column:
    """A link target joined with its base, dot segments and percent signs as written."""
    return (
        F.when(href == "", base["page"])
        .when(href.rlike(SCHEME), href)
        .when(href.startswith("//"), F.concat(base["scheme"], F.lit(":"), href))
        .when(href.startswith("/"), F.concat(base["origin"], href))
        .when(href.startswith("?"), F.concat(base["path"], href))
        .when(href.startswith("#"), F.concat(base["page"], href))
        .otherwise(F.concat(base["directory"], href))
    )


def resolve_href(base: Column, href: Column) -> Column:
    """Absolute form of a link target (RFC 3986, section 5.3); percent signs stay as written."""
    return tidy_path(absolute_href(base, href))
