"""Line, path and hash expressions. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that end a line, and those stripped as blanks.
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


# the characters that BLANK stands for
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lines_of(text: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""
    parts = F.split(text, LINE_BREAK)
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)
    ).otherwise(parts)


def line_count(text: Column) -> Column:
    """Number of lines without building them twice."""
    breaks = F.regexp_count(text, F.lit(LINE_BREAK))
    ends_open = (F.length(text) > 0) & ~text.rlike(f"(?:{LINE_BREAK})\\z")
    return (breaks + ends_open.cast("int")).cast("int")


def normalize_line(line: Column) -> Column:
    """Line as compared by the duplicate finder.

    Blanks around it go, a ``#`` tail goes, quoted strings are emptied and the
    rest is lower-cased.
    """
    code = strip(F.substring_index(line, "#", 1))
    for quote in ('"', "'"):
        # most lines have no quotes and need no pattern
        code = F.when(F.contains(code, F.lit(quote)), F.regexp_replace(code, f"{quote}.*?{quote}", quote * 2)).otherwise(code)
    return F.lower(code)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def module_key(path: Column) -> Column:
    """Dotted module key of a path: pkg/core/a.py -> pkg.core.a, pkg/__init__.py -> pkg."""
    key = F.regexp_replace(slashed(path), r"\.py$", "")
    key = F.regexp_replace(F.regexp_replace(key, "/+", "/"), "^/|/$", "")
    key = F.regexp_replace(key, r"(^|/)__init__$", "")
    return F.replace(key, F.lit("/"), F.lit("."))


def message_key(message: Column) -> Column:
    return F.lower(strip(message))
