"""Relations of what documents contain, by expressions over nested documents (doc_id, tokens, children): a document is a row, so no relation shuffles, and documents may share an id or have none.

Every function also takes token rows (doc_id, pos, sub, ...), as they are stored or made from
dictionaries; these are gathered to documents by doc_id first, which there has to be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, levels, nesting, positions, scanned
from .blocks import DEFINITION

_FIELDS = ("pos", "sub", "type", "tag", "nesting", "attrs", "line_begin", "line_end", "content", "markup", "info", "hidden", "meta")


def gathered(tokens: DataFrame) -> DataFrame:
    """Token rows as nested documents. Nested documents stay as they are, without their definitions' tokens."""
    if "tokens" in tokens.columns:
        return tokens
    rows = tokens.repartition("doc_id") if not tokens.isStreaming else tokens  # both groupings use this one shuffle
    ordered = lambda found, by: F.array_sort(found, lambda a, b: a[by] - b[by])
    inner = ordered(F.collect_list(F.when(F.col("sub") > 0, F.struct(*_FIELDS))), "sub")
    tops = rows.groupBy("doc_id", "pos").agg(F.first(F.when(F.col("sub") == 0, F.struct(*_FIELDS)), ignorenulls=True).alias("t"), inner.alias("c"))
    documents = tops.where("t is not null").groupBy("doc_id").agg(ordered(F.collect_list(F.struct("pos", "t", "c")), "pos").alias("all"))
    return documents.select("doc_id", F.transform("all", lambda x: x["t"]).alias("tokens"), F.transform("all", lambda x: x["c"]).alias("children"))


def attr(name: str) -> Column:
    return value_of(F.col("attrs"), name)


def value_of(attrs: Column, name: str) -> Column:
    return F.get(F.filter(attrs, lambda a: a["key"] == name), 0)["value"]


def _said(kids: Column) -> Column:
    """The plain text of inline tokens: breaks as line ends, images by their alternative text, markup dropped."""
    one = lambda c: F.when(c["type"].isin("text", "code_inline"), c["content"]).when(c["type"].isin("softbreak", "hardbreak"), "\n").when(c["type"] == "image", value_of(c["attrs"], "alt"))
    return F.array_join(F.transform(kids, one), "")


def plain_text(tokens: DataFrame) -> DataFrame:
    """(doc_id, pos, text) of each inline token with children."""
    texts = F.transform(F.arrays_zip("tokens", "children"), lambda x: F.when(F.size(x["children"]) > 0, F.struct(x["tokens"]["pos"].alias("pos"), _said(x["children"]).alias("text"))))
    return gathered(tokens).select("doc_id", F.inline(F.filter(texts, lambda x: x.isNotNull())))


def _of_blocks(tokens: DataFrame, wanted, fields) -> DataFrame:
    """A row per wanted block token; ``fields(token, place)`` gives its columns."""
    found = F.filter(F.transform("tokens", lambda t, i: F.when(wanted(t, i), F.struct(*fields(t, i)))), lambda x: x.isNotNull())
    return gathered(tokens).select("doc_id", F.inline(found))


def headings(tokens: DataFrame) -> DataFrame:
    follow = lambda i: F.get("tokens", i + 1)  # the inline token
    return _of_blocks(tokens, lambda t, i: t["type"] == "heading_open", lambda t, i: [follow(i)["pos"].alias("pos"), F.substring(t["tag"], 2, 1).cast("int").alias("level"), _said(F.get("children", i + 1)).alias("text")])


def paragraphs(tokens: DataFrame) -> DataFrame:
    follow = lambda i: F.get("tokens", i + 1)
    return _of_blocks(tokens, lambda t, i: t["type"] == "paragraph_open", lambda t, i: [follow(i)[c].alias(c) for c in ("pos", "line_begin", "line_end", "content")])


def code(tokens: DataFrame) -> DataFrame:
    lang = lambda t: F.coalesce(F.element_at(t["meta"], "lang"), F.lit(""))
    return _of_blocks(tokens, lambda t, i: t["type"].isin("fence", "code_block"), lambda t, i: [t["pos"].alias("pos"), lang(t).alias("lang"), F.trim(t["info"]).alias("info"), t["content"].alias("content")])


def _of_children(tokens: DataFrame, found) -> DataFrame:
    """``found(children, place of their token)`` gives an array of structs."""
    every = F.transform("children", lambda kids, i: F.when(F.size(kids) > 0, found(kids, F.get("tokens", i)["pos"])))
    return gathered(tokens).select("doc_id", F.inline(F.flatten(F.filter(every, lambda x: x.isNotNull()))))


def links(tokens: DataFrame) -> DataFrame:
    """(doc_id, pos, sub, href, title, text): a row per link; its text is that of the tokens between its two tags. Links hold no links, so the n-th closing tag belongs to the n-th opening one."""

    def found(kids: Column, pos: Column) -> Column:
        inner = lambda a, b: F.filter(F.slice(kids, a + 2, b - a - 1), lambda c: c["type"].isin("text", "code_inline"))
        text = lambda a, b: F.array_join(F.transform(inner(a, b), lambda c: c["content"]), "")
        one = lambda a, b: let(F.get(kids, a), lambda t: F.struct(pos.alias("pos"), t["sub"].alias("sub"), value_of(t["attrs"], "href").alias("href"), value_of(t["attrs"], "title").alias("title"), text(a, b).alias("text")))
        return F.zip_with(positions(kids, lambda c: c["type"] == "link_open"), positions(kids, lambda c: c["type"] == "link_close"), one)

    return _of_children(tokens, found)


def emphasis(tokens: DataFrame) -> DataFrame:
    """(doc_id, pos, sub, kind, content): the texts that directly follow an opening em, strong or s."""
    kind = lambda c: F.replace(c["type"], F.lit("_open"), F.lit(""))
    pair = lambda kids, pos: F.transform(kids, lambda c, k: F.struct(pos.alias("pos"), c["sub"].alias("sub"), kind(F.get(kids, k - 1)).alias("kind"), c["type"].alias("type"), c["content"].alias("content")))
    return _of_children(tokens, pair).where("kind in ('em', 'strong', 's') and type = 'text'").drop("type")


def images(tokens: DataFrame) -> DataFrame:
    one = lambda t, pos: F.struct(pos.alias("pos"), t["sub"].alias("sub"), *[value_of(t["attrs"], a).alias(a) for a in ("src", "alt", "title")])
    return _of_children(tokens, lambda kids, pos: F.transform(F.filter(kids, lambda c: c["type"] == "image"), lambda t: one(t, pos)))


def cells(tokens: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, col, is_header, align, content).

    Of a document only the openers of tables, rows and cells are kept. A row has as many cells as its table's header, so the
    places follow from the distance to the table's opener.
    """
    entry = lambda t, i: F.struct(t["type"].alias("type"), t["pos"].alias("pos"), t["attrs"].alias("attrs"), F.get("tokens", i + 1)["content"].alias("content"))
    entries = F.filter(F.transform("tokens", entry), lambda e: e["type"].isin("table_open", "tr_open", "th_open", "td_open"))

    def placed(entries: Column) -> Column:
        opened = positions(entries, lambda e: e["type"] == "table_open")
        others = lambda k: F.transform(F.slice(entries, k + 3, F.size(entries)), lambda e: e["type"] != "th_open")  # after the opener and the header's row
        width = lambda k: F.coalesce(F.nullif(F.array_position(others(k), True), F.lit(0)), F.size(entries) - k - 1) - 1
        tables = F.transform(opened, lambda k: F.struct(k.alias("k"), width(k).cast("int").alias("width"), F.get(entries, k)["pos"].alias("pos")))

        def cell(e: Column, k: Column, t: Column) -> Column:
            at = k - t["k"] - 1
            align = F.regexp_extract(F.coalesce(value_of(e["attrs"], "style"), F.lit("")), "text-align:(.*)", 1)
            row, col = F.floor(at / (t["width"] + 1)).cast("int"), (at % (t["width"] + 1) - 1).cast("int")
            return F.struct(t["pos"].alias("table_id"), row.alias("row"), col.alias("col"), (e["type"] == "th_open").alias("is_header"), align.alias("align"), e["content"].alias("content"))

        last = lambda tables, k: F.element_at(F.filter(tables, lambda t: t["k"] < k), -1)
        every = lambda tables: F.transform(entries, lambda e, k: F.when(e["type"].isin("th_open", "td_open"), let(last(tables, k), lambda t: cell(e, k, t))))
        return F.filter(let(tables, every), lambda c: c.isNotNull())

    return gathered(tokens).select("doc_id", F.inline(let(entries, placed)))


#: ``cells`` under the name that it has for token rows.
table_cells = cells

#: The token types that ``list_items`` reads of token rows.
LIST_TYPES = ("list_item_open", "list_item_close", "paragraph_open", "inline")


def list_items(tokens: DataFrame) -> DataFrame:
    """(doc_id, item_pos, ordered, marker, number, checked, tight, content): items with the text of their first inline token, if one stands before the item's end and any item inside."""
    edges = positions(F.col("tokens"), lambda t: t["type"].isin("list_item_open", "list_item_close"))

    def item(edges: Column, at: Column, k: Column) -> Column:
        t = F.get("tokens", at)
        own = F.slice("tokens", at + 2, F.coalesce(F.get(edges, k + 1), F.size("tokens")) - at - 1)
        first = lambda kind: F.get(F.filter(own, lambda x: x["type"] == kind), 0)
        return F.when(
            t["type"] == "list_item_open",
            F.struct(
                t["pos"].alias("item_pos"), (t["info"] != "").alias("ordered"), t["markup"].alias("marker"), F.when(t["info"] != "", t["info"].cast("int")).alias("number"), (F.element_at(t["meta"], "checked") == "true").alias("checked"),
                first("paragraph_open")["hidden"].alias("tight"), F.coalesce(first("inline")["content"], F.lit("")).alias("content"),
            ),
        )

    found = let(edges, lambda e: F.transform(e, lambda at, k: item(e, at, k)))
    return gathered(tokens).select("doc_id", F.inline(F.filter(found, lambda x: x.isNotNull())))


def alerts(tokens: DataFrame) -> DataFrame:
    return _of_blocks(tokens, lambda t, i: t["type"] == "alert_open", lambda t, i: [t["pos"].alias("pos"), F.element_at(t["meta"], "kind").alias("kind"), t["line_begin"].alias("line_begin"), t["line_end"].alias("line_end")])


def _block(t: Column, level: Column | None = None) -> Column:
    own = [F.lit(0).alias(c) if c == "sub" else t[c].alias(c) for c in _FIELDS]
    return F.struct(*own, *([level.alias("level")] if level is not None else []))


def _child(c: Column, pos: Column, level: Column | None = None) -> Column:
    """An inline token with the fields of all tokens."""
    none = F.lit(None).cast("int")
    other = {"pos": pos, "line_begin": none, "line_end": none, "hidden": F.lit(False)}
    return F.struct(*[other.get(x, c[x] if x not in other else None).alias(x) for x in _FIELDS], *([level.alias("level")] if level is not None else []))


def leveled(tokens: DataFrame) -> DataFrame:
    """All tokens as rows with ``level``: how many openers are open before; the children of an inline token start again at 0."""
    nested = gathered(tokens)
    if "children" not in nested.columns:
        nested = nested.withColumn("children", F.transform("tokens", lambda t: F.array().cast(_child_type(nested))))
    kids = lambda i, pos: let(levels(F.get("children", i)), lambda deep: F.transform(F.get("children", i), lambda c, k: _child(c, pos, F.get(deep, k))))
    with_kids = lambda t, i, level: F.concat(F.array(_block(t, level)), F.when(F.size(F.get("children", i)) > 0, kids(i, t["pos"])).otherwise(F.array().cast(_rows_type())))
    every = let(levels(F.col("tokens")), lambda deep: F.transform("tokens", lambda t, i: with_kids(t, i, F.get(deep, i))))
    return nested.select("doc_id", F.inline(F.flatten(every))).where(F.col("type") != DEFINITION)


_ATTRS = "array<struct<key:string,value:string>>"
_TYPES = {"pos": "int", "sub": "int", "nesting": "int", "line_begin": "int", "line_end": "int", "hidden": "boolean", "attrs": _ATTRS, "meta": "map<string,string>"}


def _rows_type() -> str:
    return "array<struct<" + ",".join(f"{c}:{_TYPES.get(c, 'string')}" for c in _FIELDS) + ",level:int>>"


def _child_type(nested: DataFrame) -> str:
    return "array<struct<" + ",".join(f"{c}:{_TYPES.get(c, 'string')}" for c in _FIELDS if c not in ("pos", "line_begin", "line_end", "hidden")) + ">>"


_OWN = ("tag", "attrs", "content", "markup", "info", "meta", "hidden", "line_begin", "line_end")


def nodes(tokens: DataFrame, inline: bool = False) -> DataFrame:
    """The syntax tree: doc_id, node_id (position of the opening or single token), parent_id (-1: the document), child_idx, type, close_pos, previous and next sibling, and the token's own columns.

    A scan over the tokens with a stack of open ones gives each its parent; a closer is its opener's partner, and siblings are
    what stands before an opener and behind its closer. With ``inline`` the tree goes on below inline
    tokens, and positions count all tokens of the document in order.
    """
    nested = gathered(tokens)
    kept = lambda t: t["type"] != DEFINITION
    if inline:
        # An inline token is open until its children end; the closers put there are no tokens and have no position.
        opened = lambda t: F.struct(*[(F.lit(1) if c == "nesting" else F.lit(0) if c == "sub" else t[c]).alias(c) for c in _FIELDS])
        shut = lambda t: F.struct(*[(F.lit(-1) if c == "nesting" else F.lit(-1) if c == "sub" else t[c]).alias(c) for c in _FIELDS])
        group = lambda t, i: F.when(t["type"] == "inline", F.concat(F.array(opened(t)), F.transform(F.get("children", i), lambda c: _child(c, t["pos"])), F.array(shut(t)))).otherwise(F.array(_block(t)))
        items = F.flatten(F.filter(F.transform("tokens", lambda t, i: F.when(kept(t), group(t, i))), lambda x: x.isNotNull()))
        places = scanned(F.col("_items"), F.lit(0), lambda n, t: (n + F.when(t["sub"] >= 0, 1).otherwise(0)).cast("int"), lambda n, t: n, "int")
    else:
        items = F.filter(F.transform("tokens", lambda t: _block(t)), kept)
        places = F.transform("_items", lambda t: t["pos"])
    found = nested.select("doc_id", items.alias("_items")).select("doc_id", "_items", nesting(F.col("_items")).alias("_nest"), places.alias("_place"))
    # Openers and closers pair up one to one: sorted by opener, closers stand in the order of the openers.
    closers = F.array_sort(F.filter(F.zip_with("_nest", "_items", lambda x, t: F.when(t["nesting"] == -1, F.struct(x["parent"].alias("open"), x["at"].alias("close")))), lambda x: x.isNotNull()))
    rank = scanned(F.col("_items"), F.lit(0), lambda n, t: (n + F.when(t["nesting"] == 1, 1).otherwise(0)).cast("int"), lambda n, t: n, "int")
    found = found.select("*", closers.alias("_closers"), rank.alias("_rank"))
    place = lambda at: F.when(at >= 0, F.get("_place", at)).otherwise(at)

    def node(t: Column, i: Column) -> Column:
        x = F.get("_nest", i)
        shut = F.when(t["nesting"] == 1, F.get("_closers", F.get("_rank", i))["close"]).otherwise(i)
        before, follow = F.get("_items", i - 1), F.get("_items", shut + 1)
        previous = F.when(before["nesting"] == 0, i - 1).when(before["nesting"] == -1, F.get("_nest", i - 1)["parent"])
        return F.struct(
            F.get("_place", i).alias("node_id"), place(x["parent"]).alias("parent_id"), x["idx"].alias("child_idx"), F.regexp_replace(t["type"], "_open$", "").alias("type"),
            F.when(t["type"].endswith("_open"), F.get("_place", shut)).otherwise(F.get("_place", i)).alias("close_pos"),
            place(previous).alias("previous_id"), F.when(follow["nesting"] >= 0, F.get("_place", shut + 1)).alias("next_id"), *[t[c].alias(c) for c in _OWN],
        )

    every = F.filter(F.transform("_items", lambda t, i: F.when(t["nesting"] >= 0, node(t, i))), lambda x: x.isNotNull())
    return found.select("doc_id", F.inline(every))


def to_tokens(tree: DataFrame) -> DataFrame:
    """The tokens of ``nodes``, in their form (doc_id, pos, type, tag, nesting, ...): a node with a closing position gives two."""
    nested = F.col("close_pos") != F.col("node_id")
    none, no_attrs = F.lit(None).cast("int"), F.array().cast(_ATTRS)
    first = F.struct(F.col("node_id").alias("pos"), F.concat("type", F.when(nested, "_open").otherwise("")).alias("type"), "tag", nested.cast("int").alias("nesting"), "attrs", "line_begin", "line_end", "content", "markup", "info", "hidden", "meta")
    no_meta = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    last = F.struct(
        F.col("close_pos").alias("pos"), F.concat("type", F.lit("_close")).alias("type"), "tag", F.lit(-1).alias("nesting"), no_attrs.alias("attrs"), none.alias("line_begin"), none.alias("line_end"),
        F.lit("").alias("content"), "markup", F.lit("").alias("info"), "hidden", no_meta.alias("meta"),
    )
    return tree.select("doc_id", F.inline(F.when(nested, F.array(first, last)).otherwise(F.array(first))))


def subtree(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, and the columns of ``tree``): the nodes at and below each of ``roots`` (doc_id, node_id), in the order of node_id."""
    tops = tree.join(roots.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_semi").select("doc_id", F.col("node_id").alias("root_id"), F.col("close_pos").alias("until"))
    return tree.join(tops, "doc_id").where(F.col("node_id").between(F.col("root_id"), F.col("until"))).drop("until")


def nesting_errors(tokens: DataFrame) -> DataFrame:
    """(doc_id, pos, at, type, problem): tokens that do not nest, in a document's blocks (pos null) or in the children of an inline token.

    Every closer is matched with the last opener that is still open: ``crossed`` if their tags differ, ``unopened`` if none is
    open; an opener that is never closed is ``unclosed``. ``at`` is the token's pos, or its sub among children.
    """

    def found(items: Column, pos: Column, place: str) -> Column:
        def errors(nest: Column) -> Column:
            closed = lambda x, t: F.when(t["nesting"] == -1, x["parent"])
            shut = F.filter(F.zip_with(nest, items, closed), lambda x: x >= 0)
            wrong = lambda x, t: F.when((t["nesting"] == -1) & (x["parent"] < 0), "unopened").when((t["nesting"] == -1) & ~x["tag"].eqNullSafe(t["tag"]), "crossed")
            bad = F.zip_with(nest, items, lambda x, t: F.struct(pos.cast("int").alias("pos"), t[place].alias("at"), t["type"].alias("type"), wrong(x, t).alias("problem")))
            opened = positions(items, lambda t: t["nesting"] == 1)
            left = F.transform(F.array_except(opened, shut), lambda at: let(F.get(items, at), lambda t: F.struct(pos.cast("int").alias("pos"), t[place].alias("at"), t["type"].alias("type"), F.lit("unclosed").alias("problem"))))
            return F.concat(F.filter(bad, lambda e: e["problem"].isNotNull()), left)

        return let(nesting(items), errors)

    nested = gathered(tokens)
    kept = F.filter("tokens", lambda t: t["type"] != DEFINITION)
    every = found(kept, F.lit(None), "pos")
    if "children" in nested.columns:
        inner = F.transform("children", lambda kids, i: F.when(F.size(kids) > 0, found(kids, F.get("tokens", i)["pos"], "sub")))
        every = F.concat(every, F.flatten(F.filter(inner, lambda x: x.isNotNull())))
    return nested.select("doc_id", F.inline(every))


def badly_nested(tokens: DataFrame) -> DataFrame:
    """(doc_id, pos) of token groups with ``nesting_errors``: a document's blocks (pos null), or the children of an inline token."""
    return nesting_errors(tokens).select("doc_id", "pos").distinct()


def pretty(tokens: DataFrame, indent: int = 2, show_text: bool = False) -> DataFrame:
    """(doc_id, tree): the syntax tree of a document as indented lines, a node to a line."""
    nested = gathered(tokens)

    def line(t: Column, depth: Column) -> Column:
        said = F.array_join(F.transform(t["attrs"], lambda a: F.concat(F.lit(" "), a["key"], F.lit("='"), a["value"], F.lit("'"))), "")
        shown = F.concat(F.repeat(F.lit(" "), depth * indent), F.lit("<"), F.regexp_replace(t["type"], "_open$", ""), said, F.lit(">"))
        if not show_text:
            return shown
        own = F.concat(F.lit("\n"), F.repeat(F.lit(" "), (depth + 1) * indent))
        return F.when(t["type"] == "text", F.concat(shown, own, F.replace(t["content"], F.lit("\n"), own))).otherwise(shown)

    def lines(items: Column, above: Column) -> Column:
        return let(levels(items), lambda deep: F.filter(F.transform(items, lambda t, i: F.when((t["nesting"] >= 0) & (t["type"] != DEFINITION), line(t, above + F.get(deep, i) + 1))), lambda x: x.isNotNull()))

    def block(deep: Column) -> Column:
        one = lambda t, i: F.concat(F.array(line(t, F.get(deep, i) + 1)), F.when(F.size(F.get("children", i)) > 0, lines(F.get("children", i), F.get(deep, i) + 1)).otherwise(F.array().cast("array<string>")))
        return F.flatten(F.filter(F.transform("tokens", lambda t, i: F.when((t["nesting"] >= 0) & (t["type"] != DEFINITION), one(t, i))), lambda x: x.isNotNull()))

    tree = F.concat(F.lit("<root>"), F.array_join(F.transform(let(levels(F.col("tokens")), block), lambda x: F.concat(F.lit("\n"), x)), ""))
    return nested.select("doc_id", tree.alias("tree"))
