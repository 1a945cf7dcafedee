"""What a line's first characters say of it, as an expression: the line relation of documents, before containers are looked into."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (class, pattern), the first that fits counts; in the syntax that both Java's and RE2's patterns have.
CLASSES = [
    ("blank", r"^[ \t]*$"),
    ("code", r"^( {4}| {0,3}\t)"),
    ("quote", r"^ {0,3}>"),
    ("heading", r"^ {0,3}#{1,6}([ \t]|$)"),
    ("fence", r"^ {0,3}(```+[^`]*|~~~+.*)$"),
    ("setext", r"^ {0,3}(=+|--+)[ \t]*$"),
    ("break", r"^ {0,3}((\*[ \t]*){3,}|(-[ \t]*){3,}|(_[ \t]*){3,})$"),
    ("bullet", r"^ {0,3}[-+*]([ \t]|$)"),
    ("number", r"^ {0,3}[0-9]{1,9}[.)]([ \t]|$)"),
    ("html", r"^ {0,3}<[A-Za-z/!?]"),
    ("definition", r"^ {0,3}\[[^\]]+\]:"),
    ("table", r"^ {0,3}[^|]*\|"),
]


def line_class(line: Column) -> Column:
    """The class of a line, ``text`` if no pattern fits. What a line is in a document also depends on the lines before it."""
    found = F.when(F.lit(False), "")
    for name, pattern in CLASSES:
        found = found.when(line.rlike(pattern), name)
    return found.otherwise("text")


def line_class_sql(line: str) -> str:
    """The same as SQL."""
    cases = " ".join(f"WHEN regexp_matches({line}, '{pattern}') THEN '{name}'" for name, pattern in CLASSES)
    return f"CASE {cases} ELSE 'text' END"
