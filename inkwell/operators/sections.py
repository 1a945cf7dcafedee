"""Long documents as several rows: cut, by expressions over their lines, where the line classes prove that nothing is open.

A cut stands before a line at the margin, behind a blank line, that is no list item: whatever quote, list, table, paragraph or
indented code was open has ended there. A fence at the margin may still be open, so a state machine goes through the fences and the lines that may be cut before, in order,
and knows which fence is open; its work is in proportion to the lines. From the first line on that may open something else at the document's level (HTML, or a fence that is indented) there are no cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let, scanned
from ..functions.text import normalize_reference
from ..plans.config import Syntax
from . import blocks, inlines
from .lines import line_class

#: A section has at least so many lines, the last one too: a shorter rest stays with the section before.
LINES = 1000
#: A text of more than 2 * SALTS documents is dealt out in SALTS parts; of the at most MANY texts with the most documents.
SALTS, MANY = 32, 1000
#: What a line behind a cut may be.
_FRESH = ("text", "heading", "quote", "definition", "table", "fence")


def cut(text: Column, syntax: Syntax, least: int = LINES) -> Column:
    """The sections (section, first_line, text, more: whether there are others) of a text whose line ends are normal; a short one, or one that nowhere can be cut, is one section."""
    whole = F.array(F.struct(F.lit(0).alias("section"), F.lit(0).alias("first_line"), text.alias("text"), F.lit(False).alias("more")))
    fences = syntax.active("block", "fence")

    def found(lines: Column) -> Column:
        n = F.size(lines)
        unclear = lambda line, c: (c == "html") | line.rlike(r"^[ \t]+(```|~~~)")

        def looks(classes: Column, end: Column) -> Column:
            """Where something may begin: the place, whether a section may begin there, and the mark of a fence (``bare``: it may close one)."""

            def look(c: Column, i: Column) -> Column:
                line = F.get(lines, i)
                fresh = c.isin(*_FRESH) & ~line.rlike("^[ \t]") & F.coalesce(F.get(classes, i - 1) == "blank", F.lit(False))
                fence = (c == "fence") & F.lit(fences)
                said = F.struct(i.alias("at"), fresh.alias("fresh"), F.when(fence, F.regexp_extract(line, "^(`+|~+)", 1)).otherwise("").alias("mark"), (fence & line.rlike("^(`+|~+)[ \t]*$")).alias("bare"))
                return F.when((i < end) & (fence | fresh), said)

            return F.filter(F.transform(classes, look), lambda x: x.isNotNull())

        def starts(looks: Column) -> Column:
            cuts = lambda s, x: (s["mark"] == "") & x["fresh"] & (x["at"] - s["last"] >= least) & (n - x["at"] >= least)
            closes = lambda s, x: x["bare"] & (F.substring(x["mark"], 1, 1) == F.substring(s["mark"], 1, 1)) & (F.length(x["mark"]) >= F.length(s["mark"]))
            mark = lambda s, x: F.when(s["mark"] == "", x["mark"]).when(closes(s, x), "").otherwise(s["mark"])
            step = lambda s, x: F.struct(mark(s, x).alias("mark"), F.when(cuts(s, x), x["at"]).otherwise(s["last"]).alias("last"))
            made = scanned(looks, F.struct(F.lit("").alias("mark"), F.lit(0).alias("last")), step, lambda s, x: F.when(cuts(s, x), x["at"]), "int")
            return F.concat(F.array(F.lit(0)), F.filter(made, lambda i: i.isNotNull()))

        def places(classes: Column) -> Column:
            bad = F.array_position(F.zip_with(lines, classes, unclear), True)
            end = let(bad, lambda bad: F.when(bad > 0, bad - 1).otherwise(n))
            return let(let(end, lambda end: looks(classes, end)), starts)

        until = lambda starts, k: F.coalesce(F.get(starts, k + 1), n)
        section = lambda starts, s, k: F.struct(k.alias("section"), s.alias("first_line"), F.array_join(F.slice(lines, s + 1, until(starts, k) - s), "\n").alias("text"), (F.size(starts) > 1).alias("more"))
        return let(let(F.transform(lines, line_class), places), lambda starts: F.transform(starts, lambda s, k: section(starts, s, k)))

    return F.when(_is_short(text, least), whole).otherwise(let(F.split(text, "\n"), found))


def _is_short(text: Column, least: int) -> Column:
    return F.regexp_count(text, F.lit("\n")) < 2 * least


def _loose(text: Column) -> Column:
    """A text without what its lines may begin with in containers, without white space and escapes: equal labels stay equal, wherever they are broken. Escaped brackets become other characters."""
    text = F.replace(F.replace(F.regexp_replace(text, r"\\\\", ""), F.lit("\\["), F.lit("\ue000")), F.lit("\\]"), F.lit("\ue001"))
    return F.upper(F.concat(F.lower(F.regexp_replace(text, r"(?U)[\s>\\]+", "")), F.lit("")))


def nested(docs: DataFrame, syntax: Syntax | None = None, *, id_col: str = "doc_id", text_col: str = "text", least: int = LINES) -> DataFrame:
    """(doc_id, section, first_line, tokens, children): a row per section, parsed on its own; lines count from the document's first, positions from the section's.

    Definitions hold for the whole document: those of documents with more sections than one are collected first (only sections with a line that begins with a bracket
    are folded for it), and joined to the sections that name them in brackets, by the digest of the document's text; ids may repeat or be null. So a section gets what it may
    use, not all of its document, and the sections of a document are dealt out, those of a text that many documents have in parts. Short documents stay where they are.
    """
    syntax = syntax or Syntax.preset()
    source = blocks.sources(docs, syntax, id_col, text_col)
    is_short, key = _is_short(F.col("text"), least), ["text_key", "section"]
    text_key = F.coalesce(F.sha2("text", 256), F.lit("")).alias("text_key")
    whole = source.where(~is_short).select("doc_id", text_key, cut(F.col("text"), syntax, least).alias("parts"))
    pieces = whole.select("doc_id", "text_key", F.inline_outer("parts"))  # no text has none; ``inline`` and a filter on the size of ``parts`` would be pushed down, and every text be cut for each of them
    different = pieces.where("more").select("text_key", F.coalesce("section", F.lit(0)).alias("section"), "text").dropDuplicates(key)  # keys that cannot be null, so that both uses have one plan, which runs once
    defining = different.where(F.col("text").rlike(r"(?m)^[ \t>*+\-0-9.)]*\["))
    found = blocks.parse(defining.select(F.struct(*key).alias("doc_id"), "text"), syntax).where(F.col("type") == blocks.DEFINITION)
    found = found.select("doc_id.*", "pos", _loose(F.col("info")).alias("loose"), normalize_reference(F.col("info")).alias("label"), F.struct(F.col("content").alias("href"), F.col("markup").alias("title")).alias("to"))
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("text_key", "label").orderBy("section", "pos"))).where("rank = 1").select("text_key", "loose", "label", "to")
    named = different.select(*key, F.explode_outer(F.regexp_extract_all(_loose(F.col("text")), F.lit(r"\[([^\[\]]++)\]"), F.lit(1))).alias("loose")).distinct()
    # merge joins: Spark does not count what the explodes add
    common = named.join(first.hint("merge"), ["text_key", "loose"]).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("label", "to"))).alias("common"))
    copies = source.where(~is_short).groupBy(text_key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * SALTS)
    many = F.broadcast(copies.orderBy(F.desc("n")).limit(MANY).select("text_key", F.lit(True).alias("many")))
    salts = F.explode(F.when(F.col("many"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    common = common.join(many, "text_key", "left").select(*key, "common", salts)
    salted = pieces.join(many, "text_key", "left").withColumn("salt", F.when(F.col("many"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0))
    known = salted.join(common.hint("merge"), [*key, "salt"], "left").select("doc_id", "section", "first_line", "text", "common")
    short = source.where(is_short).select("doc_id", F.lit(0).alias("section"), F.lit(0).alias("first_line"), "text", F.lit(None).cast(known.schema["common"].dataType).alias("common"))
    known = short.unionByName(known).select(F.struct("doc_id", "section", "first_line").alias("doc_id"), "text", "common")
    parsed = inlines.parsed(known, syntax, own_first=False).withColumnRenamed("doc_id", "_key")
    moved = lambda t: t.withField("line_begin", t["line_begin"] + F.col("_key.first_line")).withField("line_end", t["line_end"] + F.col("_key.first_line"))
    return parsed.select("_key.*", F.transform("tokens", moved).alias("tokens"), "children")
