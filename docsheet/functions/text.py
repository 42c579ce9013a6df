"""Characters and control codes of document text as column functions.

Control codes (fixed values): 06 paragraph, 07 line, 08 page, 09 tab, 0A hard tab, 0B hard hyphen, 0C soft hyphen, 0E object, 0F visible space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def printable(text: Column) -> Column:
    """A dot for all but printable ASCII."""
    return F.regexp_replace(text, r"[^\x20-\x7e]", ".")


def ascii_only(text: Column) -> Column:
    """No-break spaces become spaces, other characters beyond ASCII question marks."""
    return F.regexp_replace(F.translate(text, "\u00a0", " "), r"[^\x00-\x7f]", "?")


def ascii_html(text: Column) -> Column:
    """Characters beyond ASCII as numeric entities."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"[^\x00-\x7f]"), F.concat(F.lit("&#x"), F.lower(F.hex(F.ascii(c))), F.lit(";"))).otherwise(c)), "")


def render_text(text: Column) -> Column:
    """Control codes as plain text: breaks are line feeds, tabs tabs, hyphens hyphens, the visible space a space; others go."""
    shown = F.translate(text, "\x06\x07\x08\x09\x0a\x0b\x0c\x0f", "\n\n\n\t\t-- ")
    return F.regexp_replace(shown, r"[\x00-\x05\x0e\x10-\x1a\x1c-\x1f]", "")


def render_html(text: Column, line_break: str = "<br/>") -> Column:
    """Control codes as HTML: breaks are ``line_break``, tabs and visible spaces spaces, hyphens hyphens; others go. Markup characters are escaped."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    spaced = F.regexp_replace(F.translate(safe, "\x09\x0a\x0f\x0b\x0c", "   --"), r"[\x06-\x08]", line_break)
    return F.regexp_replace(spaced, r"[\x00-\x1f]", "")


def css_name(name: Column) -> Column:
    """A style name as a CSS class."""
    return F.regexp_replace(name, r"[\x00-\x20\x7f-\xa0]", "_")


def attribute(text: Column) -> Column:
    """Text as part of a quoted attribute."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))


def css_class(name: Column) -> Column:
    """The class of a style by its name, for an attribute; without a name that of the normal style."""
    return attribute(css_name(F.coalesce(name, F.lit("Normal"))))


def heading_level(name: Column) -> Column:
    """1 to 6 for styles named like "Heading 2", else null."""
    return F.regexp_extract(name, r"Heading.([1-6])", 1).try_cast("int")


def font_bucket(points: Column) -> Column:
    """HTML font size 1 to 7 of a size in points."""
    return F.when(points < 8, 1).when(points < 10, 2).when(points < 13, 3).when(points < 17, 4).when(points < 24, 5).when(points < 36, 6).otherwise(7)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by code point."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def paragraphs(text: Column, mark: str = "\x06") -> Column:
    """The paragraphs of a text: each ends with ``mark``; a rest after the last one counts."""
    parts = F.split(text, mark)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def section(paragraphs: Column) -> Column:
    """Text section of an array of paragraphs: a 06 after each; without any text the bytes 06 02."""
    return F.when(F.size(paragraphs) > 0, F.concat(F.array_join(F.transform(paragraphs, lambda p: F.coalesce(p, F.lit(""))), "\x06"), F.lit("\x06"))).otherwise(F.lit("\x06\x02"))


def encode(text: Column, charset: str) -> Column:
    """Bytes in UTF8, UCS2 (big-endian; a question mark for characters that take more than 16 bits) or ASCII."""
    return {"UTF8": F.encode(text, "UTF-8"), "UCS2": F.encode(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "?"), "UTF-16BE"), "ASCII": F.encode(ascii_only(text), "US-ASCII")}[charset]
