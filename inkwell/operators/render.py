"""Rendering by expressions: a nested document to its HTML without a shuffle, render rules among them; or token rows by one window and one ordered aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.attrs import attr_join
from ..functions.text import escape_html
from ..plans.config import Syntax
from .blocks import DEFINITION


def attributes(attrs: Column) -> Column:
    return F.array_join(F.transform(attrs, lambda a: F.concat(F.lit(" "), a["key"], F.lit('="'), escape_html(a["value"]), F.lit('"'))), "")


def levels(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``level``: openers still open before the token; the children of an inline token start again at 0."""
    order = Window.partitionBy("doc_id", F.when(F.col("sub") > 0, F.col("pos"))).orderBy("pos", "sub")
    return tokens.withColumn("level", F.sum("nesting").over(order) - (F.col("nesting") == 1).cast("int"))


def _piece(get, before: Column, after: Column, block: Column, syntax: Syntax) -> Column:
    """The HTML of one token; ``get`` gives its columns, ``before`` and ``after`` are the block tokens around it (null for inline tokens)."""
    options = syntax.options
    opens, closes, kind = get("nesting") == 1, get("nesting") == -1, get("type")
    tight = opens & ((after["type"] == "inline") | after["hidden"] | ((after["nesting"] == -1) & (after["tag"] == get("tag"))))
    tag = F.concat(
        F.when(block & ~closes & F.coalesce(before["hidden"], F.lit(False)), "\n").otherwise(""), F.when(closes, "</").otherwise("<"), get("tag"), attributes(get("attrs")),
        F.when((get("nesting") == 0) & F.lit(options["xhtmlOut"]), " />").otherwise(">"), F.when(block & ~F.coalesce(tight, F.lit(False)), "\n").otherwise(""),
    )
    box = lambda on: F.concat(tag, F.lit(f'<input class="task-list-item-checkbox"{"" if options.get("tasklists_editable") else " disabled=" + chr(34) * 2} type="checkbox"{" checked=" + chr(34) * 2 if on else ""}> '))
    text = escape_html(get("content"))
    lang = F.coalesce(F.element_at(get("meta"), "lang"), F.lit(""))
    classed = F.when(lang != "", attr_join(get("attrs"), "class", F.concat(F.lit(options["langPrefix"]), lang))).otherwise(get("attrs"))
    code = F.concat(F.lit("<pre><code"), attributes(classed), F.lit(">"), text, F.lit("</code></pre>\n"))
    if options.get("highlight"):  # a function from (content, lang) to a column; null or empty text means none
        shown = options["highlight"](get("content"), lang)
        code = F.when(F.coalesce(shown, F.lit("")) == "", code).when(shown.startswith("<pre"), F.concat(shown, F.lit("\n"))).otherwise(F.concat(F.lit("<pre><code"), attributes(classed), F.lit(">"), shown, F.lit("</code></pre>\n")))
    line_break = "<br />\n" if options["xhtmlOut"] else "<br>\n"
    plain = {
        "text": text, "inline": F.lit(""), "softbreak": F.lit(line_break if options["breaks"] else "\n"), "hardbreak": F.lit(line_break), "code_inline": F.concat(F.lit("<code"), attributes(get("attrs")), F.lit(">"), text, F.lit("</code>")),
        "code_block": F.concat(F.lit("<pre"), attributes(get("attrs")), F.lit("><code>"), text, F.lit("</code></pre>\n")), "fence": code, "html_block": get("content"), "html_inline": get("content"),
        "list_item_open": F.when(F.element_at(get("meta"), "checked") == "true", box(True)).when(F.element_at(get("meta"), "checked") == "false", box(False)).otherwise(tag),
    }
    piece = F.when(get("hidden"), "")
    for name, value in plain.items():
        piece = piece.when(kind == name, value)
    return piece.otherwise(tag)


_ROW = ("type", "tag", "nesting", "attrs", "line_begin", "line_end", "content", "markup", "info", "hidden", "meta")


def html(syntax: Syntax | None = None, rules: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """The HTML of a nested document (tokens, children) as an expression: no shuffle.

    ``rules`` override what a token type gives: each is a function from a token, a struct with the fields of token rows, to
    its HTML. Hidden tokens stay hidden.
    """
    syntax = syntax or Syntax.preset()
    nothing = {"hidden": F.lit(False), "line_begin": F.lit(None).cast("int"), "line_end": F.lit(None).cast("int")}
    full = lambda c: F.struct(*[nothing.get(k, c[k] if k not in nothing else None).alias(k) for k in _ROW])

    def ruled(t: Column, otherwise: Column) -> Column:
        piece = F.when(F.lit(False), "")
        for kind, rule in (rules or {}).items():
            piece = piece.when(t["type"] == kind, let(full(t), rule))
        return piece.otherwise(otherwise) if rules else otherwise

    tokens = F.filter("tokens", lambda t: t["type"] != DEFINITION)
    children = F.filter("children", lambda c, i: F.get("tokens", i)["type"] != DEFINITION)
    none = F.lit(None).cast("struct<type:string,hidden:boolean,nesting:int,tag:string>")
    child = lambda c: ruled(c, _piece(lambda k: F.lit(False) if k == "hidden" else c[k], none, none, F.lit(False), syntax))

    def block(tokens: Column, children: Column) -> Column:
        said = lambda i: F.array_join(F.transform(F.get(children, i), child), "")
        plain = lambda t, i: _piece(lambda k: t[k], F.get(tokens, i - 1), F.get(tokens, i + 1), F.lit(True), syntax)
        own = lambda t, i: F.when(t["hidden"], plain(t, i)).otherwise(ruled(t, plain(t, i))) if rules else plain(t, i)
        piece = lambda t, i: F.when((t["type"] == "inline") & ~t["hidden"], said(i)).otherwise(own(t, i))
        return F.array_join(F.transform(tokens, piece), "")

    return let(F.struct(tokens.alias("t"), children.alias("c")), lambda x: block(x["t"], x["c"]))


def pieces(tokens: DataFrame, syntax: Syntax, rules: dict[str, Callable[[DataFrame], Column]] | None = None) -> DataFrame:
    """(doc_id, pos, sub, piece): what each token row adds to the HTML. ``rules`` override the piece of a token type; here they may also name columns. A doc_id is a document."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    around = F.struct("type", "hidden", "nesting", "tag")
    blocks = tokens.where("sub = 0 or sub is null").withColumns({"_before": F.lag(around).over(order), "_next": F.lead(around).over(order)})
    nothing = F.lit(None).cast(blocks.schema["_next"].dataType)
    rows = blocks.unionByName(tokens.where("sub > 0").withColumns({"_before": nothing, "_next": nothing}))
    piece = F.when(F.lit(False), "")
    for kind, rule in (rules or {}).items():
        piece = piece.when(~F.col("hidden") & (F.col("type") == kind), rule(rows))
    return rows.select("doc_id", "pos", "sub", piece.otherwise(_piece(F.col, F.col("_before"), F.col("_next"), F.col("sub") == 0, syntax)).alias("piece"))


def render(tokens: DataFrame, syntax: Syntax | None = None, rules: dict[str, Callable[[DataFrame], Column]] | None = None) -> DataFrame:
    """(doc_id, html) for every document with a token row."""
    rows = pieces(tokens, syntax or Syntax.preset(), rules)
    inner = F.transform(F.array_sort(F.collect_list(F.struct("pos", "sub", "piece"))), lambda x: x["piece"])
    return rows.groupBy("doc_id").agg(F.array_join(inner, "").alias("html"))
