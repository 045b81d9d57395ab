"""Page inspection. Every function is a narrow projection: the wide markup is never shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlens.functions import html as H
from harvestlens.functions.staging import pinned
from harvestlens.functions.text import is_blank
from harvestlens.functions.urls import absolute_href, base_of, tidy_path

MAX_TEXT = 20_000
MAX_HTML_PREVIEW = 50_000
MAX_LINKS = 200

# Texts that mark a security challenge. Fixed values.
CHALLENGE_MARKS = (
    "/tspd/",
    "tspd_",
    "failureconfig",
    "challenge.support_id",
    "captcha",
    "verify you are human",
    "verification required",
    "checking your browser",
    "checking your browser before accessing",
    "security check",
    "access denied",
    "bot detection",
    "automated access",
    "are you a robot",
    "human verification",
    "cloudflare",
    "perimeterx",
    "imperva",
    "incapsula",
)

BLOCKED_MESSAGE = "This is a security check of the site, not the page behind it; it is not worked around."
EMPTY_MESSAGE = "The page loaded, but it shows neither text nor links."


# A mark that contains another one adds nothing to the test.
_TESTED_MARKS = [m for m in CHALLENGE_MARKS if not any(o != m and o in m for o in CHALLENGE_MARKS)]


def challenge_type(haystack: str) -> Column:
    """``anti_bot_challenge`` when a column of lower-cased text holds any mark, else NULL."""
    # Plain substring tests stay in generated code and beat one pattern with all marks.
    hit = " OR ".join(f"contains({haystack}, '{mark}')" for mark in _TESTED_MARKS)
    return F.expr(f"CASE WHEN {hit} THEN 'anti_bot_challenge' END")


def detect_blocked(df: DataFrame, html: str = "html", text: str = "text", title: str = "title",
                   url: str = "url") -> DataFrame:
    """Add ``block_type``. False alarms in prose are part of the contract."""
    # The joined text is a column of its own, so that it is built once and not once per mark.
    joined = df.withColumn("_haystack", F.lower(F.concat_ws("\n", html, text, title, url)))
    return pinned(joined, block_type=challenge_type("_haystack")).drop("_haystack")


def page_titles(df: DataFrame, html: str = "html") -> DataFrame:
    """Add ``title``, '' when the page has none."""
    return pinned(df, _title=H.title_text(H.rendered_markup(F.col(html)))).withColumn(
        "title", H.decode_entities(F.col("_title"))
    ).drop("_title")


def page_texts(df: DataFrame, html: str = "html", limit: int = MAX_TEXT) -> DataFrame:
    """Add ``text``: visible text or, when that is blank, all body text; cut to ``limit``."""
    return (
        _with_text(pinned(df, _markup=H.rendered_markup(F.col(html))), html)
        .withColumn("text", F.left("_text", F.lit(limit)))
        .drop("_markup", "_text")
    )


def _with_text(df: DataFrame, html: str) -> DataFrame:
    """Add the uncut ``_text``; one step per column, because each is read more than once."""
    visible = H.with_marked_text(df, "_markup", "_marked").withColumn(
        "_visible", H.tidy_lines(H.decode_entities(F.col("_marked")))
    )
    all_text = H.decode_entities(H.full_text(F.col(html)))
    text = F.when(is_blank(F.col("_visible")), all_text).otherwise(F.col("_visible"))
    return pinned(visible, _text=text).drop("_marked", "_visible")


def _with_base(df: DataFrame, url: str) -> DataFrame:
    """Add ``_base``: what targets are resolved against, the first base element of ``_markup``, itself resolved, or the URL."""
    found = pinned(df, _first=H.base_target(F.col("_markup")))
    found = pinned(found, _joined=absolute_href(base_of(F.col(url)), F.col("_first")))
    found = pinned(found, _from=F.when(F.col("_first") == "", F.col(url)).otherwise(tidy_path(F.col("_joined"))))
    return found.withColumn("_base", base_of(F.col("_from"))).drop("_first", "_joined", "_from")


def page_links(df: DataFrame, html: str = "html", url: str = "url", limit: int = MAX_LINKS) -> DataFrame:
    """Add ``links`` (first ``limit``) as ARRAY<STRUCT<text, href>>, in document order."""
    marked = pinned(df, _markup=H.rendered_markup(F.col(html)))
    cut = _with_base(marked.withColumn("_chunks", H.anchor_chunks(F.col("_markup"))), url)
    links = F.slice(H.links_of(F.col("_chunks"), F.col("_base")), 1, limit)
    return pinned(cut, links=links).drop("_chunks", "_base", "_markup")


def explode_links(df: DataFrame, key: str, links: str = "links") -> DataFrame:
    """One row (key, pos, text, href) per kept link, position from 0."""
    return df.select(key, F.posexplode(links).alias("pos", "link")).select(
        key, F.col("pos").cast("long").alias("pos"), "link.text", "link.href"
    )


def page_link_counts(df: DataFrame, html: str = "html") -> DataFrame:
    """Add ``link_count``, before any cut."""
    return df.withColumn("link_count", H.count_links(H.rendered_markup(F.col(html))).cast("long"))


def page_frames(df: DataFrame, html: str = "html") -> DataFrame:
    """Add ``iframe_count``, the main frame included."""
    return df.withColumn("iframe_count", H.count_frames(H.rendered_markup(F.col(html))).cast("long"))


def page_html_stats(df: DataFrame, html: str = "html") -> DataFrame:
    """Add ``html_length`` and ``html_preview``."""
    return df.withColumn("html_length", F.length(html).cast("long")).withColumn(
        "html_preview", F.left(html, F.lit(MAX_HTML_PREVIEW))
    )


def inspect_pages(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Replace the markup of each page by its inspection record.

    A blocked page stays blocked even when it is empty; an empty page has
    neither text nor links. Columns nobody selects are pruned, the link array
    included, and the job is one stage without a shuffle.
    """
    page = F.coalesce(F.col(html), F.lit(""))
    staged = df.withColumn(html, page)
    staged = pinned(staged, _markup=H.rendered_markup(F.col(html)))
    staged = staged.withColumn("_title", H.title_text(F.col("_markup")))
    staged = pinned(staged, title=H.decode_entities(F.col("_title")))
    staged = detect_blocked(_with_text(staged, html), html, "_text", "title", url)
    staged = staged.withColumn("blocked", F.col("block_type").isNotNull())
    links = H.count_links(F.col("_markup"))
    empty = ~F.col("blocked") & is_blank(F.col("_text"))
    staged = pinned(staged, _n_links=links, _blank=empty)
    staged = staged.withColumn("_empty", F.col("_blank") & (F.col("_n_links") == 0)).withColumn(
        "_chunks", H.anchor_chunks(F.col("_markup"))
    )
    staged = _with_base(staged, url)
    kept = [c for c in df.columns if c not in (html, url)]
    return staged.select(
        *kept,
        (~F.col("blocked") & ~F.col("_empty")).alias("success"),
        "blocked",
        "block_type",
        F.when(~F.col("blocked"), F.col("_empty")).alias("empty_page"),
        F.lit(True).alias("recoverable"),
        F.col(url).alias("url"),
        "title",
        F.when(F.col("_empty"), "").otherwise(F.left("_text", F.lit(MAX_TEXT))).alias("text"),
        F.slice(H.links_of(F.col("_chunks"), F.col("_base")), 1, MAX_LINKS).alias("links"),
        F.col("_n_links").cast("long").alias("link_count"),
        H.count_frames(F.col("_markup")).cast("long").alias("iframe_count"),
        F.length(html).cast("long").alias("html_length"),
        F.left(html, F.lit(MAX_HTML_PREVIEW)).alias("html_preview"),
        F.when(F.col("blocked"), BLOCKED_MESSAGE).when(F.col("_empty"), EMPTY_MESSAGE).alias("message"),
    )


def open_results(df: DataFrame, key: str, status_code: str | None = None) -> DataFrame:
    """Outcome of opening each page: url, title and status code (NULL when unknown)."""
    status = F.col(status_code).cast("int") if status_code else F.lit(None).cast("int")
    return page_titles(df).select(key, F.lit(True).alias("success"), "url", "title", status.alias("status_code"))
