"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    """Line ends as ``\\n``; NUL as U+FFFD."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\x00", "�")


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def validate_link(url: Column) -> Column:
    """Whether a link may be emitted: script, file and data URLs may not, but for some image types."""
    bare = F.lower(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""))
    return ~bare.rlike("^(vbscript|javascript|file|data):") | bare.rlike("^data:image/(gif|png|jpeg|webp);")


def normalize_reference(label: Column) -> Column:
    """Labels that differ in case or inner white space are one. The concat keeps the optimiser from dropping lower()."""
    squeezed = F.regexp_replace(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return F.upper(F.concat(F.lower(squeezed), F.lit("")))


def is_link_open(tag: Column) -> Column:
    return tag.rlike(r"(?i)^<a[>\s]")


def is_link_close(tag: Column) -> Column:
    return tag.rlike(r"(?i)^</a\s*>")
