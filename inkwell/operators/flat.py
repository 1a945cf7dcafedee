"""Blocks of texts without containers, by expressions over their lines: no Python.

The classes of the lines and a state (nothing, a paragraph or indented code is open) say of every line which block it belongs to and
whether it begins one; the runs of lines from one beginning to the next are the blocks. What a text must not hold to be parsed this way is in ``is_flat``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, positions, scanned
from ..plans.config import Syntax
from . import blocks
from .blocks import TOKEN_STRUCT
from .lines import line_class

#: The rules whose work is done here; where one is off, texts are folded.
RULES = ("code", "fence", "hr", "heading", "lheading", "paragraph")
#: Classes that begin containers or blocks of other kinds.
_OTHERS = ("quote", "bullet", "number", "html", "definition", "table")
# What Python's str.strip takes off.
_SPACE = r"[\t-\r\x1c-\x1f \x85\xa0  -     　]"
_INSIDE = "fenced"


def states(lines: Column, classes: Column, fences: Column) -> Column:
    """(kind, begins) of each line: blank, heading, break, fenced, paragraph, underline or code."""
    kind = lambda line, c, i: F.when(F.exists(fences, lambda f: (f["first"] <= i) & (i <= f["last"])), _INSIDE).when((c == "setext") & ~line.rlike(r"^ *---"), "double").otherwise(c)
    kinds = F.transform(F.arrays_zip(lines.alias("line"), classes.alias("c")), lambda x, i: F.struct(kind(x["line"], x["c"], i).alias("k"), F.exists(fences, lambda f: f["first"] == i).alias("first")))

    def said(mode: Column, x: Column) -> Column:
        k = x["k"]
        return (
            F.when(k.isin("blank", "heading", "break", _INSIDE), k).when((mode == "paragraph") & k.isin("setext", "double"), "underline").when(k == "setext", "break")
            .when((k == "code") & (mode != "paragraph"), "code").otherwise("paragraph")
        )

    def after(mode: Column, x: Column) -> Column:
        now = said(mode, x)
        return F.when(now.isin("paragraph", "code"), now).when((now == "blank") & (mode == "code"), mode).otherwise("")

    emit = lambda mode, x: let(said(mode, x), lambda now: F.struct(now.alias("kind"), (F.when(now == _INSIDE, x["first"]).when(now.isin("heading", "break"), True).when(now.isin("paragraph", "code"), now != mode).otherwise(False)).alias("begins")))
    return scanned(kinds, F.lit(""), after, emit, "struct<kind:string,begins:boolean>")


def is_flat(lines: Column, classes: Column, fences: Column, syntax: Syntax) -> Column:
    """Whether a text may be parsed here: outside of fences no line begins a container, a table, HTML or a definition, no bracket stands at a line's begin, no tab indents, no fence is indented, and no fence's info has an escape or an entity."""
    if not all(syntax.active("block", rule) for rule in RULES):
        return F.lit(False)
    outside = lambda i: ~F.exists(fences, lambda f: (f["first"] <= i) & (i <= f["last"]))
    odd = lambda line, c: c.isin(*_OTHERS) | line.rlike(r"^ {0,3}\[|^ *\t")
    opener = lambda i: F.exists(fences, lambda f: f["first"] == i)
    bad = F.transform(F.arrays_zip(lines.alias("line"), classes.alias("c")), lambda x, i: x["line"].rlike("^ +(```|~~~)") | F.when(outside(i), odd(x["line"], x["c"])).otherwise(opener(i) & x["line"].rlike(r"[\\&]")))
    return ~F.exists(bad, lambda b: b)


def _token(kind, tag="", nesting=0, begin=None, end=None, content="", markup="", info="", lang=None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    number = lambda x: (F.lit(x) if x is None else x).cast("int")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    meta = none if lang is None else F.when(lang != "", F.create_map(F.lit("lang"), lang)).otherwise(none)
    return F.struct(
        F.lit(0).alias("pos"), text(kind).alias("type"), text(tag).alias("tag"), F.lit(nesting).alias("nesting"), F.array().cast("array<struct<key:string,value:string>>").alias("attrs"), number(begin).alias("line_begin"), number(end).alias("line_end"),
        text(content).alias("content"), text(markup).alias("markup"), text(info).alias("info"), F.lit(False).alias("hidden"), meta.alias("meta"),
    ).cast(TOKEN_STRUCT)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def _paragraph(b: Column) -> Column:
    """A paragraph, or a heading by its underline."""
    last = F.array_position(F.transform(b["kinds"], lambda k: k != "paragraph"), True) - 1
    content = lambda n: _strip(F.array_join(F.transform(F.slice(b["own"], 1, n), lambda x: F.regexp_replace(x, r"^[ \t]+", "")), "\n"))

    def made(n: Column) -> Column:
        under = F.coalesce(F.get(b["kinds"], n) == "underline", F.lit(False))
        sign = F.substring(F.regexp_replace(F.get(b["own"], n), "^ +", ""), 1, 1)
        tag, markup = F.when(under, F.when(sign == "=", "h1").otherwise("h2")).otherwise("p"), F.when(under, sign).otherwise("")
        kind, end = F.when(under, "heading").otherwise("paragraph"), b["begin"] + n + under.cast("int")
        return F.array(
            _token(F.concat(kind, F.lit("_open")), tag, 1, b["begin"], end, markup=markup), _token("inline", "", 0, b["begin"], end, content(n)), _token(F.concat(kind, F.lit("_close")), tag, -1, markup=markup)
        )

    return let(F.when(last >= 0, last).otherwise(F.size(b["own"])).cast("int"), made)


def _heading(b: Column) -> Column:
    def made(x: Column) -> Column:
        marks = F.regexp_extract(x, "^(#+)", 1)
        title = _strip(F.regexp_replace(F.regexp_replace(x, "^#+[ \t]*", ""), r"(?:^|[ \t]+)#+[ \t]*\z", ""))
        tag, end = F.concat(F.lit("h"), F.length(marks).cast("string")), b["begin"] + 1
        return F.array(_token("heading_open", tag, 1, b["begin"], end, markup=marks), _token("inline", "", 0, b["begin"], end, title), _token("heading_close", tag, -1, markup=marks))

    return let(F.regexp_replace(F.get(b["own"], 0), "^ +", ""), made)


def _break(b: Column) -> Column:
    bare = F.ltrim(F.get(b["own"], 0))
    mark = F.substring(bare, 1, 1)
    return F.array(_token("hr", "hr", 0, b["begin"], b["begin"] + 1, markup=F.repeat(mark, F.length(bare) - F.length(F.replace(bare, mark, F.lit(""))) + 1)))


def _ended(items: Column) -> Column:
    """Lines with their ends."""
    return F.array_join(F.transform(items, lambda x: F.concat(x, F.lit("\n"))), "")


def _code(b: Column) -> Column:
    body = lambda last: _ended(F.transform(F.slice(b["own"], 1, last + 1), lambda x: F.regexp_replace(x, "^ {1,4}", "")))
    return let(F.array_max(positions(b["kinds"], lambda k: k == "code")), lambda last: F.array(_token("code_block", "code", 0, b["begin"], b["begin"] + last + 1, body(last))))


def _fence(b: Column) -> Column:
    inside = F.size(F.filter(b["kinds"], lambda k: k == _INSIDE))
    ticks = F.regexp_extract(F.get(b["own"], 0), "^(`+|~+)", 1)
    info = F.regexp_replace(F.get(b["own"], 0), "^(`+|~+)", "")
    body = lambda n: _ended(F.slice(b["own"], 2, F.greatest(n - 1 - (b["end"] - b["begin"] < n).cast("int"), F.lit(0))))
    return let(inside, lambda n: F.array(_token("fence", "code", 0, b["begin"], b["begin"] + n, body(n), ticks, info, F.regexp_extract(info, f"^{_SPACE}*([^{_SPACE[1:-1]}]+)", 1))))


def _block(b: Column) -> Column:
    """The tokens of a block (own lines, their kinds, begin, end of its fence)."""
    kind = F.get(b["kinds"], 0)
    return F.when(kind == "paragraph", _paragraph(b)).when(kind == "heading", _heading(b)).when(kind == "break", _break(b)).when(kind == "code", _code(b)).otherwise(_fence(b))


def fences_of(lines: Column, classes: Column, end: Column) -> Column:
    """(first, last) of the fences at the margin that begin before ``end``; one that is not closed lasts until ``end``."""
    none = F.array().cast("array<struct<first:int,last:int>>")
    start = F.struct(F.lit(None).cast("int").alias("at"), F.lit("").alias("mark"), none.alias("done"))
    mark = lambda i: F.struct(i.alias("at"), F.regexp_extract(F.get(lines, i), "^(`+|~+)", 1).alias("mark"), F.get(lines, i).rlike("^(`+|~+)[ \t]*$").alias("bare"))
    looks = F.transform(F.filter(positions(classes, lambda c: c == "fence"), lambda i: (i < end) & ~F.get(lines, i).startswith(" ")), mark)

    def step(s: Column, x: Column) -> Column:
        closes = x["bare"] & (F.substring(x["mark"], 1, 1) == F.substring(s["mark"], 1, 1)) & (F.length(x["mark"]) >= F.length(s["mark"]))
        done = F.concat(s["done"], F.array(F.struct(s["at"].alias("first"), x["at"].alias("last"))))
        opened = F.struct(x["at"].alias("at"), x["mark"].alias("mark"), s["done"].alias("done"))
        closed = F.struct(F.lit(None).cast("int").alias("at"), F.lit("").alias("mark"), done.alias("done"))
        return F.when(s["at"].isNull(), opened).when(closes, closed).otherwise(s)

    left = lambda s: F.when(s["at"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["at"].alias("first"), end.cast("int").alias("last")))))
    return F.aggregate(looks, start, step, left)


def parsed(text: Column, syntax: Syntax) -> Column:
    """The block tokens of a text with normal line ends if it is flat, else null."""

    def found(lines: Column) -> Column:
        def known(x: Column) -> Column:
            return F.when(is_flat(lines, x["classes"], x["fences"], syntax), tokens(lines, x["classes"], x["fences"]))

        return let(F.transform(lines, line_class), lambda classes: let(F.struct(classes.alias("classes"), fences_of(lines, classes, F.size(lines)).alias("fences")), known))

    return let(F.split(F.regexp_replace(text, "\n\\z", ""), "\n"), found)


def nested(docs: DataFrame, syntax: Syntax | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens), what ``blocks.nested`` gives: flat documents by expressions in the JVM, the others by the fold.

    The texts are read twice, once for each part. Interpreted expressions take about four times as long as the fold; this is for
    sessions in which most documents are flat and Python workers are dear.
    """
    syntax = syntax or Syntax.preset()
    source = blocks.sources(docs, syntax, id_col, text_col).select("doc_id", "text", parsed(F.col("text"), syntax).alias("tokens"))
    rest = source.where("tokens is null").select("doc_id", "text")
    return source.where("tokens is not null").select("doc_id", "tokens").unionByName(blocks.folded(rest, syntax))


def tokens(lines: Column, classes: Column, fences: Column) -> Column:
    """The block tokens of a flat text. ``fences``: (first, last) line of each; a last line behind the text's says that it is not closed."""
    n = F.size(lines)

    def blocks(found: Column) -> Column:
        starts = positions(found, lambda x: x["begins"])
        until = lambda starts, k: F.coalesce(F.get(starts, k + 1), n)
        end = lambda s: F.get(F.filter(fences, lambda f: f["first"] == s), 0)["last"]
        own = lambda s, n: F.struct(F.slice(lines, s + 1, n).alias("own"), F.transform(F.slice(found, s + 1, n), lambda x: x["kind"]).alias("kinds"), s.alias("begin"), end(s).alias("end"))
        one = lambda starts, s, k: let(own(s, until(starts, k) - s), _block)
        return let(starts, lambda starts: F.flatten(F.transform(starts, lambda s, k: one(starts, s, k))))

    made = let(states(lines, classes, fences), blocks)
    return F.transform(made, lambda t, i: t.withField("pos", i.cast("int")))
