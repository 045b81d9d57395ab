"""Text and number expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points Python's str.strip() removes, as characters and as a pattern that Java and RE2 read alike.
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANK = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def trim_blank(value: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(value, F.lit(WHITE))


def is_blank(value: Column) -> Column:
    """True for NULL, empty text and text made of white space only."""
    return F.ltrim(F.coalesce(value, F.lit("")), F.lit(WHITE)) == ""


def round4(value: Column) -> Column:
    """Round to four places through a decimal, so that engines agree on ties."""
    return F.round(value.cast("decimal(18,8)"), 4).cast("double")


def path_of(root: str, *parts: Column) -> Column:
    """Join a root and path parts with slashes."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), *parts)


def literal_map(values: Mapping[str, str]) -> Column:
    """Constant MAP<STRING, STRING>, built from one text so that a long table costs a single call to the JVM."""
    packed = "\x02".join(f"{key}\x03{value}" for key, value in values.items())
    return F.str_to_map(F.lit(packed), F.lit("\x02"), F.lit("\x03"))
